"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a hash of its doc_id. A source takes documents below a threshold of that hash,
so the choice needs no sort, is the same in every run and grows with the budget (what a smaller
budget takes, a larger one takes as well). The threshold is found from the top bits down: sum the
words by source and bucket of LEVEL_BITS bits, find the bucket in which the budget ends, then sum
again within that bucket alone by the next bits, until the 64 bits are used. Only the boundary
bucket is ever refined; the documents are scanned once and reduced to (doc_id, size, source).

Targets. Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share SHARE of all
words; no source gets more than MOST times its words, and what it can't take is reshared by weight.
The level at which budget and caps meet is found by turns over the table of sources, of
which there may be many: they are numbered range by range, and nothing about them reaches the driver but sums.

A source that is due r times its words takes every document floor(r) times and a hash threshold of
its documents once more. The boundary document goes in or out, whichever is nearer to the target.

Defined cases: a null text has size 0 and takes 0; rows that share a doc_id are taken alike; a null
doc_id hashes as one more id; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import cut, quoted, shuffle_partitions

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
LEVEL_BITS = 13
HASH_BITS = 64
#: Rows from which a source is dealt out by salts, and how many sources are so at most.
LARGE, MOST_LARGE = 10_000, 1_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size, h): skey orders sources by code point with null last."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), "source"))
    return docs.select("doc_id", key.alias("skey"), words.alias("size"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(2)).alias("h"))


def _numbered(by_source: DataFrame) -> DataFrame:
    """by_source with n, the place of each source in order from 0: counted range by range, so that no task numbers all."""
    spark = by_source.sparkSession
    ranged = cut(by_source.repartitionByRange(shuffle_partitions(spark), "skey").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("c"))  # a row for each partition
    before = counts.select("_part", (F.sum("c").over(Window.orderBy("_part")) - F.col("c")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy("skey")) - 1
    return ranged.withColumn("_inner", inner).join(before, "_part").select(*by_source.columns, (F.col("_before") + F.col("_inner")).alias("n"))


def targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, target) per source.

    The level, a target by unit of weight, is found as the contract says it: the budget is shared by weight, sources above
    their cap are set to it, and what is left is shared among the others until none is above. Each
    turn is one aggregate of two numbers; the level only rises, so what is capped stays so.
    """
    by_source = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    weighed = cut(_numbered(by_source).select("skey", "source_size", weight.alias("w"), (MOST * F.col("source_size")).alias("cap")))
    budget = SHARE * (weighed.agg(F.sum("source_size")).head()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        row = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("w"))), F.count(F.when(full, 1))).head()
        if row[1] is None or row[2] == capped:  # none is left, or none was above in the last turn
            break
        level, capped = (budget - row[0]) / row[1], row[2]
    return weighed.select("skey", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target") if capped >= 0 else F.col("cap").alias("target"))


def _prefix(bits: int):
    return F.shiftrightunsigned("h", HASH_BITS - bits) if bits < HASH_BITS else F.col("h")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs."""
    sized = cut(sizes(docs))
    due = cut(
        targets(sized).select(
            "*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies")
        ).select("*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    )
    # (skey, at, spare): documents whose prefix is below `at` are in, `spare` words of the budget are left
    state = due.where("budget > 0").select("skey", F.lit(0).cast("long").alias("at"), F.col("budget").alias("spare"))
    bits, rows = 0, sized.select("skey", "size", "h").where("size > 0")
    while bits < HASH_BITS:
        inside = rows if not bits else rows.join(state.select("skey", "at"), (rows.skey == state.skey) & (_prefix(bits) == state["at"])).drop(state.skey)
        bits = min(bits + LEVEL_BITS, HASH_BITS)
        # summed by source and cell before a source's cells, a bounded number, come together
        cells = inside.groupBy("skey", _prefix(bits).alias("cell")).agg(F.sum("size").alias("words")).join(state.select("skey", "spare"), "skey")
        # cells in unsigned order of the bits: below 64 bits they are not negative, at 64 the parent's sign is shared
        upto = F.sum("words").over(Window.partitionBy("skey").orderBy("cell"))
        over = cells.select("skey", "cell", "words", "spare", upto.alias("upto")).where(F.col("upto") > F.col("spare"))
        first = over.groupBy("skey").agg(F.min(F.struct("cell", "words", "upto", "spare")).alias("x"))
        state = cut(first.select("skey", F.col("x.cell").alias("at"), (F.col("x.spare") - F.col("x.upto") + F.col("x.words")).alias("spare"), F.col("x.words").alias("edge")))
    edge = state
    # the boundary cell is now one hash: in, if more than half of its words fit
    last = edge.select("skey", F.col("at").alias("edge_h"), (2 * F.col("spare") >= F.col("edge")).alias("edge_in"))
    table = due.join(last, "skey", "left")
    # unsigned order of hashes: flip the sign bit
    flip = F.lit(-(1 << 63))
    extra = (
        F.when(F.col("budget") <= 0, 0)
        .when(F.col("edge_h").isNull(), 1)
        .when(F.col("h").bitwiseXOR(flip) < F.col("edge_h").bitwiseXOR(flip), 1)
        .when((F.col("h") == F.col("edge_h")) & F.col("edge_in"), 1)
        .otherwise(0)
    )
    # a large source's row is there once for each salt, so that its documents meet it in many tasks; the others' rows once
    salts = shuffle_partitions(docs.sparkSession)
    n = sized.count()
    large = sized.groupBy("skey").agg(F.count("*").alias("n")).where(F.col("n") > max(LARGE, n // MOST_LARGE)).select("skey", F.lit(True).alias("_large"))  # MOST_LARGE rows at most
    salted = table.join(large, "skey", "left").withColumn("_salt", F.explode(F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    dealt = sized.join(large, "skey", "left").withColumn("_salt", F.when(F.col("_large"), F.pmod("h", F.lit(salts)).cast("int")).otherwise(0))
    return dealt.join(salted.drop("_large"), ["skey", "_salt"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + extra)).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with their columns as they were, whatever their names.

    Documents without a word have nothing to take and go.
    """
    names = docs.columns
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("taken div size")).cast("int").alias("copies"))
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    picked = plain.join(taken, F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("id")))
    return picked.select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy").toDF(*names)
