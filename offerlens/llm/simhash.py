"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, components.

Fingerprints: 4-word shingles of the lower-cased words, repeats included, hashed by XXH64 with
seed 42; a bit is 1 if it is set in over half of the hashes. Two fingerprints link at RADIUS or
fewer differing bits.

Comparison. Six runs of bits cover the 64; two fingerprints with at most four differing bits agree
exactly on two of the six runs at least, so each of the fifteen pairs of runs deals fingerprints
into buckets of 20 to 22 equal bits, and every link lies within a bucket. A bucket is compared
exactly in tiles: numpy exclusive-or and bit counts, tile against tile, in order of population
count, and tile pairs whose population counts differ beyond the radius are skipped. Within a
bucket the linked part is grown outward and leaves the list of those still to be reached, so a
dense group of n copies costs about n comparisons and yields n - 1 links, not n squared. A bucket
beyond BUCKET fingerprints is dealt out as pairs of tiles over several tasks.

Equal fingerprints are collapsed first, so a group of copies of any size is one fingerprint.

Defined cases: a null text or one without words has fingerprint zero and links like any other;
texts of one to three words are one shingle; repeated rows and repeated doc_ids share a component;
a component of which no row has a doc_id has a null component_id; doc_ids are any longs, up to both
ends of their range; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import cut, id_and_bytes, quoted, shuffle_partitions
from offerlens.llm.components import connected_components

RADIUS = 4
WORDS = 4
RUNS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 256
BUCKET = 1 << 16


def fingerprint(body: bytes, width: int = WORDS) -> int:
    """The fingerprint of one text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = body.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())]
    n, total = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = np.array(hashes[at : at + 8192], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype="<u8")
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return id_and_bytes(docs, key).mapInArrow(_fingerprints, "doc_id long, fp long")


def bucket_links(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the distinct fingerprints of one bucket, or of one tile with others, exactly as all links would.

    fps (and others) are unsigned. Grows each component outward from a seed: a tile of its frontier
    against the tiles of what is not yet reached, by population count, skipping tiles out of reach.
    """
    everything = fps if others is None else np.concatenate([fps, others])
    pops = np.bitwise_count(everything).astype(np.int16)
    order = np.lexsort((everything, pops))
    rest, pop = everything[order], pops[order]
    left, right = [], []
    while len(rest) > 1:
        frontier, rest, pop = rest[:1], rest[1:], pop[1:]
        while len(frontier) and len(rest):
            front, frontier = frontier[:tile], frontier[tile:]
            low, high = int(np.bitwise_count(front).min()), int(np.bitwise_count(front).max())
            reached = np.zeros(len(rest), bool)
            for at in range(int(np.searchsorted(pop, low - radius)), int(np.searchsorted(pop, high + radius, "right")), tile):
                part = slice(at, min(at + tile, len(rest)))
                if pop[part][0] > high + radius or pop[part][-1] < low - radius:
                    continue
                near = np.bitwise_count(rest[part, None] ^ front[None, :]) <= radius
                hit = near.any(axis=1)
                if hit.any():
                    reached[part] = hit
                    left.append(front[near[hit].argmax(axis=1)])
                    right.append(rest[part][hit])
            if reached.any():
                frontier = np.concatenate([frontier, rest[reached]])
                rest, pop = rest[~reached], pop[~reached]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tile pair, side, fp, node) sorted by bucket and tile pair; a bucket may run over batches. Links are pairs of nodes."""

    def links(fp: np.ndarray, side: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
        if len(fp) < 2:
            return None
        a, b = bucket_links(fp[side == 0], others=fp[side == 1]) if side.any() else bucket_links(fp)
        if not len(a):
            return None
        order = np.argsort(fp)
        ends = [node[order][np.searchsorted(fp[order], x)] for x in (a, b)]
        return pa.record_batch([pa.array(x) for x in ends], names=["a", "b"])

    open_key, open_fp, open_side, open_node = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, pair, side = (batch.column(i).to_numpy() for i in range(3))
        fp, node = batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()
        edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(pair) != 0)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(fp)]
        found: list[pa.RecordBatch] = []
        for s, e in zip(starts, ends):
            key = (bucket[s], pair[s])
            if key != open_key:
                if open_fp and (out := links(*map(np.concatenate, (open_fp, open_side, open_node)))):
                    found.append(out)
                open_key, open_fp, open_side, open_node = key, [], [], []
            open_fp.append(fp[s:e])
            open_side.append(side[s:e])
            open_node.append(node[s:e])
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
    if open_fp and (out := links(*map(np.concatenate, (open_fp, open_side, open_node)))):
        yield out


def links(prints: DataFrame, bucket_limit: int = BUCKET) -> DataFrame:
    """(a, b): links between nodes that leave the same components as all links. prints(fp, node): no fp twice."""
    posts = []
    for k, (x, y) in enumerate(combinations(RUNS, 2)):
        bits = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << n) - 1) for s, n in (x, y)]
        posts.append(F.lit(k << 22) + F.shiftleft(bits[0], y[1]) + bits[1])
    posted = prints.select("fp", "node", F.explode(F.array(*posts)).alias("bucket"))
    counts = posted.groupBy("bucket").count().where(F.col("count") > 1)
    small = F.col("count") <= bucket_limit
    held = posted.join(counts, "bucket")
    # a large bucket is dealt into tiles, and each pair of tiles is a group of its own
    tiles = F.ceil(F.col("count") / bucket_limit).cast("int")
    large = held.where(~small).withColumn("tile", F.pmod(F.xxhash64("fp"), tiles).cast("int")).withColumn("tiles", tiles)
    paired = large.select("bucket", "fp", "node", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "tiles").select(
        "bucket",
        (F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other") + 1).alias("pair"),
        F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side"),
        "fp",
        "node",
    )
    rows = held.where(small).select("bucket", F.lit(0).alias("pair"), F.lit(0).alias("side"), "fp", "node").union(paired)
    n = shuffle_partitions(prints.sparkSession)
    dealt = rows.repartition(n, "bucket", "pair").sortWithinPartitions("bucket", "pair")
    return dealt.select(F.col("bucket").cast("long"), F.col("pair").cast("long"), F.col("side").cast("int"), "fp", "node").mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest key of its component, null if none of it has one.

    A fingerprint's node is the smallest key that has it, so a component's smallest node is its id
    and no row has to look it up by component, which may hold a third of all. Rows that share a key
    are one document; keys are any longs.
    """
    prints = cut(fingerprints(docs, key))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    if distinct.where("node IS NULL").isEmpty():
        roots = connected_components(links(distinct))
        rooted = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    else:  # fingerprints that only rows without a key have are nodes of their own, after all keys
        nodes = cut(distinct.select("fp", F.struct(F.col("node").isNull().alias("nameless"), F.coalesce("node", "fp").alias("key")).alias("node")))
        linked = links(nodes.select("fp", F.col("fp").alias("node")))
        a, b = nodes.select(F.col("fp").alias("a"), F.col("node").alias("u")), nodes.select(F.col("fp").alias("b"), F.col("node").alias("v"))
        roots = connected_components(linked.join(a, "a").join(b, "b"), "u", "v")
        root = F.coalesce("root", "node")
        rooted = nodes.join(roots, "node", "left").select("fp", F.when(~root["nameless"], root["key"]).alias("component_id"))
    return prints.join(rooted, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with its columns as they were.

    Texts without a word are copies of one another, as their fingerprints are. Of rows that share
    the smallest doc_id, the one with the least text stays (null first), and of equal texts any. Rows without a doc_id can't be told apart and all stay.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL"))
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    # the join has dealt the rows by doc_id already
    one = kept.groupBy("doc_id").agg(F.min_by(F.struct(*quoted(docs)), F.struct("text")).alias("__row"))
    return one.select("__row.*").union(docs.where("doc_id IS NULL"))
