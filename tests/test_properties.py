"""Properties over many random rows at once."""

import random

from pyspark.sql import functions as F

from offerlens.functions import ranking, schedule
from offerlens.operators import feed, publish, registry

NAMES = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def test_every_range_of_days_wraps(spark):
    rows = [(a, b, f"{NAMES[a - 1]} - {NAMES[b - 1]}") for a in range(1, 8) for b in range(1, 8)]
    for r in spark.createDataFrame(rows, "a int, b int, t string").withColumn("d", schedule.days_in(F.col("t"))).collect():
        assert r.d == sorted({(r.a - 1 + i) % 7 + 1 for i in range((r.b - r.a) % 7 + 1)})


def test_every_time_range_is_read_as_it_is_written(spark):
    rng, rows = random.Random(1), []
    for _ in range(400):
        start = rng.randrange(0, 1380, 15)
        end = rng.randrange(start + 15, 1441, 15)
        clock = lambda m: f"{(m // 60 - 1) % 12 + 1}:{m % 60:02d}{'pm' if 720 <= m % 1440 else 'am'}"
        rows.append((start, end, f"{clock(start)} - {clock(end)}"))
    for r in spark.createDataFrame(rows, "s int, e int, t string").withColumn("w", schedule.window_in(F.col("t"))).collect():
        assert (r.w.start, r.w.end) == (r.s, r.e), r.t


def test_the_next_occurrence_is_that_of_a_walk_through_the_week(spark):
    rng = random.Random(2)
    windows = [(d, rng.randint(1, 7), s := rng.randrange(0, 1380, 30), rng.randrange(s + 30, 1441, 30)) for d in range(80) for _ in range(rng.randint(1, 4))]
    table = spark.createDataFrame(windows, "deal_id long, dow int, start int, end int")
    for dow, now in ((1, 0), (5, 1020), (7, 1439)):
        found = {r.deal_id: (r.day_ahead, r.live, r.starts_in) for r in feed.next_occurrences(table, feed.Moment(dow, now)).collect()}
        for deal in range(80):
            best = None
            for ahead in range(8):
                hits = []
                for d, w, s, e in windows:
                    if d != deal or w != (dow - 1 + ahead) % 7 + 1 or (ahead == 0 and now >= e):
                        continue
                    live = ahead == 0 and now >= s
                    hits.append((not live, 0 if live else ahead * 1440 + s - now))
                if hits:
                    best = (ahead, not min(hits)[0], min(hits)[1])
                    break
            assert found[deal] == best


def test_a_better_offer_never_ranks_lower(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.random() < 0.5, rng.randint(1, 300), rng.randint(0, 900), rng.random() * 20, rng.randint(1, 60), rng.random() * 100) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, live boolean, until int, wait int, miles double, drive int, value double")

    def total(sort, **changed):
        c = {n: F.col(n) for n in df.columns} | changed
        return ranking.score(sort, c["g"], c["live"], c["until"], c["wait"], c["miles"], c["drive"], c["value"], F.lit("likely"))

    better = {"value": {"value": F.col("value") + 5}, "nearest": {"miles": F.col("miles") / 2}, "soonest": {"wait": F.greatest(F.col("wait") - 10, F.lit(0)), "drive": F.greatest(F.col("drive") - 1, F.lit(1))}}
    for sort, change in better.items():
        assert df.where(total(sort, **change) > total(sort)).count() == 0
        assert df.where(total(sort, g=F.col("g") + 1) <= total(sort)).where("wait < 400 AND drive < 60").where("miles < 900").where(f"'{sort}' <> 'soonest' OR wait <= 180").count() == 0


def test_premises_and_unions_are_stable(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["A bar", "a BAR ", "B"]), rng.choice(["1 Main", "1 MAIN"]), "z", f"n{i}", rng.choice(["core", "taproom"])) for i in range(50)]
    schema = "lid long, name string, address string, zone_id string, number string, tier string"
    once = registry.premises(spark.createDataFrame(rows, schema))
    again = registry.premises(once.withColumnRenamed("numbers", "number"))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, addr string")
    assert {tuple(r) for r in publish.priority_union(a, a, a).collect()} == {(1, "x"), (2, "y")}
