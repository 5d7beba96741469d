"""Words of articles meet names by codes: no text is moved for each of them."""

import random
import re

from pyspark.sql import functions as F

from offerlens.operators import crawl

NAMES = [(1, "z", "Blue Moon"), (2, "z", "Blue Moon"), (3, "y", "Blue Moon"), (4, "z", "Old Oak Cellar"), (5, None, "Old Oak Cellar"), (6, "y", "Taku")]
LINES = ["Top spots", "1. Blue Moon!", "xBlue Moon, blue", "blue moons", "the xblue moon", "Old Oak Cellar", "old oak  cellar", "Happy hour Mon-Fri 4pm-6pm", "HAPPY HOUR $5 drafts", "Taku", "nice place", ""]


def _said(articles):
    """Brute force: of each venue the first line of an article that names it, with the five behind."""
    out = {}
    for lid, zone, core in ((1, "z", "blue moon"), (3, "y", "blue moon"), (4, "z", "old oak cellar")):
        for url, where, text in sorted(articles, key=lambda a: a[0]):
            lines = text.split("\n")
            plain = [re.sub(r"[^\w\s]", " ", x.lower()) for x in lines]
            at = [i for i, x in enumerate(plain) if core in x and core.split()[0] in x.split()]
            if where == zone and at:
                out.setdefault(lid, []).append((url, "\n".join(lines[at[0] : at[0] + 6])))
    return out


def test_mentions_are_those_of_brute_force_and_move_no_text_by_word(spark):
    rng = random.Random(4)
    rows = [(f"u{i:03d}", rng.choice(["z", "y", None]), "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 12)))) for i in range(200)]
    articles = spark.createDataFrame(rows, "url string, zone_id string, text string")
    venues = spark.createDataFrame(NAMES, "lid long, zone_id string, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = crawl.mentions(articles, venues)
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        found = {r.lid: r.quotes for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    blocks = [(k, url, text) for k, v in _said(rows).items() for url, text in v]
    quotes = spark.createDataFrame(blocks, "lid long, url string, text string").select("lid", "url", F.posexplode(crawl.pagetext.offer_quotes(F.col("text"))).alias("pos", "quote"))
    want = {}
    for r in quotes.orderBy("lid", "url", "pos").collect():
        want.setdefault(r.lid, {})[r.quote] = None
    assert found == {k: list(v) for k, v in want.items()} and len(found) == 3
    moved = [x for x in plan.split("\n\n") if re.search(r"Arguments: hashpartitioning\([^)]*\bword#", x)]
    assert moved and not any(re.search(r"\b(lines|plain|line)#", x.split("Arguments")[0]) for x in moved)
