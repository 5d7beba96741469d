"""Merkle manifest of a dataset: a tree of hashes for each source, one over the sources, and a proof for every row.

A row's leaf hashes its fields (FIELDS, each `-` if null, else its length in bytes, a colon and its value). A
source's leaves stand in the order of doc_id; every FANOUT consecutive nodes become the hash of their digests, put
together as text, until one is left. The sources' roots, null first and then by their bytes, are the leaves of one more
tree, whose root stands for the dataset. A row's proof is, level by level, what stands left and right of its node within its run.

Superblocks. Leaves are numbered within their source range by range, without a sort in one task. A bucket holds the
FANOUT ** LEVELS leaves that share their number's quotient; applyInPandas collapses LEVELS levels of it to one digest, so a task
holds one bucket whatever the source's size. The bucket roots are numbered by their bucket and go the same way, until
every source has one root. Proofs are put together on the way back: a bucket's own root has a proof in the pass
above (the upper part, some KB for a whole bucket), which is joined to the bucket's leaves, and the lower part is computed within it.
So digests alone are shuffled: no text after the leaf is hashed, and no proof of a row.

Defined cases: a null text, source, doc_id, lang or n_chars is `-`; rows without a doc_id come first in their source
and are never tampered with; rows that share a doc_id stand in the order of their leaves, and equal rows have equal leaves, so any
order of theirs gives one tree (their proofs differ by place); a source of one row has that leaf as its root; an empty
table gives no rows; texts of any length are hashed whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import cut, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels that a bucket collapses: it holds FANOUT ** LEVELS leaves at most.
LEVELS = 3
#: Where this divides the crc32 of the doc_id in decimal, the row is tampered with to try its proof.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """The value as text with its length in bytes before it, null as a dash: no two rows have the same frames."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(skey, doc_id, leaf, tried): skey orders sources, null first; tried is the leaf that the proof is tried with."""
    rows = docs.select(*[F.col(c).alias(c) for c in fields])
    changed = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    other = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in fields]
    key = F.coalesce(F.concat(F.lit("a"), "source"), F.lit("A"))
    return rows.select(key.alias("skey"), "doc_id", leaf_of([F.col(c) for c in fields]).alias("leaf"), F.when(changed, leaf_of(other)).alias("tried"))


def height(n: Column, fanout: int) -> Column:
    """Levels above n leaves until one node is left."""
    out, reach = F.lit(0), 1
    while reach < 1 << 62:
        out = out + F.when(n > reach, 1).otherwise(0)
        reach *= fanout
    return out.cast("int")


def collapse(hashes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from hashes up."""
    rows = [hashes]
    for _ in range(levels):
        last = rows[-1]
        rows.append([digest("".join(last[a : a + fanout])) for a in range(0, len(last), fanout)])
    return rows


def path_of(rows: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """Of the node at a place of the lowest level, what stands left and right of it within its run, level by level."""
    out = []
    for row in rows[:-1]:
        first = at - at % fanout
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + fanout])))
        at //= fanout
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its proof make."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def proof_digest(path: Sequence[tuple[str, str]]) -> str:
    return digest("".join(left + right for left, right in path))


def _pairs(path) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def _climbed(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes(skey, i, hash, up): the nodes of every pass with their bucket, from the lowest; (skey, hash) of the roots."""

    def reduced(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values("i")
        top = collapse(ordered["hash"].tolist(), min(levels, int(part["up"].iloc[0])), fanout)[-1]
        return pd.DataFrame({"skey": [key[0]], "i": [key[1]], "hash": top, "up": [max(0, int(part["up"].iloc[0]) - levels)]})

    passes, tall = [], nodes.agg(F.max("up")).head()[0] or 0
    for _ in range(max(1, -(-tall // levels))):
        bucketed = nodes.withColumn("bucket", F.expr(f"i div {fanout**levels}"))
        passes.append(bucketed)
        nodes = cut(bucketed.select("skey", "bucket", "i", "hash", "up").groupBy("skey", "bucket").applyInPandas(reduced, "skey string, i long, hash string, up int"))
    return passes, nodes.select("skey", "hash")


def _descended(passes: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(skey, bucket, upper): the path of each bucket of the lowest pass, from its own root to that of all; above has those of the roots."""

    def lengthened(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        ordered = lower.sort_values("i")
        rows = collapse(ordered["hash"].tolist(), min(levels, int(ordered["up"].iloc[0])), fanout)
        rest = _pairs(upper["upper"].iloc[0])
        paths = [[{"left": a, "right": b} for a, b in path_of(rows, k, fanout) + rest] for k in range(len(ordered))]
        return pd.DataFrame({"skey": ordered["skey"], "bucket": ordered["i"], "upper": paths})

    upper = above.select("skey", F.lit(0).cast("long").alias("bucket"), "upper")
    for nodes in reversed(passes[1:]):
        own = nodes.select("skey", "bucket", "i", "hash", "up")
        upper = cut(own.groupBy("skey", "bucket").cogroup(upper.groupBy("skey", "bucket")).applyInPandas(lengthened, f"skey string, bucket long, upper {PATH}"))
    return upper


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, keep_path: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of docs, and the proof itself (path) if asked for.

    folded_root is made of the leaf as it was tried (tampered with or not) and the row's own proof; verified says whether that is the root.
    """
    hashed = cut(leaves(docs))
    placed = cut(numbered(hashed, "skey", ("doc_id", "leaf")).withColumn("up", height(F.col("n"), fanout)))
    passes, roots = _climbed(placed.select("skey", "i", F.col("leaf").alias("hash"), "up", "doc_id", "tried"), fanout, levels)
    # the sources' roots are the leaves of one more tree
    named = roots.select(F.lit("").alias("all"), F.col("skey").alias("source_key"), "hash")
    sources = cut(numbered(named, "all", ("source_key",)).withColumn("up", height(F.col("n"), fanout)))
    tops, root = _climbed(sources.select(F.col("all").alias("skey"), "i", "hash", "up", "source_key"), fanout, levels)
    none = F.array().cast(PATH)
    over = _descended(tops, root.select("skey", none.alias("upper")), fanout, levels)

    def of_sources(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        ordered = lower.sort_values("i")
        rows = collapse(ordered["hash"].tolist(), min(levels, int(ordered["up"].iloc[0])), fanout)
        rest = _pairs(upper["upper"].iloc[0])
        paths = [path_of(rows, k, fanout) + rest for k in range(len(ordered))]
        cells = [[{"left": a, "right": b} for a, b in p] for p in paths]
        folded = [fold(h, p) for h, p in zip(ordered["hash"], paths)]
        return pd.DataFrame({"skey": ordered["source_key"], "subroot": ordered["hash"], "root": folded, "upper": cells})

    lowest = tops[0].select("skey", "bucket", "i", "hash", "up", "source_key")
    subroots = cut(lowest.groupBy("skey", "bucket").cogroup(over.groupBy("skey", "bucket")).applyInPandas(of_sources, f"skey string, subroot string, root string, upper {PATH}"))
    upper = _descended(passes, subroots.select("skey", "upper"), fanout, levels).join(subroots.select("skey", "subroot", "root"), "skey")

    def proved(lower: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        ordered = lower.sort_values("i")
        rows = collapse(ordered["hash"].tolist(), min(levels, int(ordered["up"].iloc[0])), fanout)
        top = upper.iloc[0]
        rest, root = _pairs(top["upper"]), top["root"]
        tried = ordered["tried"].where(ordered["tried"].notna(), ordered["hash"])
        out: dict[str, list] = {"proof_sha256": [], "folded_root": []}
        paths = []
        for k, leaf in enumerate(tried):
            path = path_of(rows, k, fanout) + rest
            out["proof_sha256"].append(proof_digest(path))
            out["folded_root"].append(fold(leaf, path))
            if keep_path:
                paths.append([{"left": a, "right": b} for a, b in path])
        made = pd.DataFrame({"doc_id": ordered["doc_id"], "leaf": ordered["hash"].to_numpy(), "subroot": top["subroot"], "root": root, **out})
        made["verified"] = made["folded_root"] == root
        return made.assign(path=paths) if keep_path else made

    # pandas would make floats of ids beside a null, so they pass as text
    schema = RESULT.replace("doc_id long", "doc_id string") + (f", path {PATH}" if keep_path else "")
    own = passes[0].select("skey", "bucket", "i", "hash", "up", F.col("doc_id").cast("string").alias("doc_id"), "tried")
    made = own.groupBy("skey", "bucket").cogroup(upper.groupBy("skey", "bucket")).applyInPandas(proved, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
