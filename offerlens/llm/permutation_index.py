"""Approximate nearest neighbours by a permutation index.

A vector is represented by the first POSTED pivots in the order in which it sees them, nearest first:
a partial permutation. Pivots come in pairs, a vector and its opposite, so that the far end of an
order tells as much as the near one. Every block of the index keeps one inverted file per pivot: which of its
vectors have the pivot in their permutation, and at what place. A query opens the files of its own OPENED
nearest pivots alone, and adds up, file by file, how much nearer the vectors in it come than the
footrule distance of permutations without a common pivot (a pivot that a permutation lacks stands at place
OPENED). The REFINED share of the block with the least footrule distance is ranked anew by exact
cosine in double precision, then as many again, and so on until a doubling brings no nearer vector: among
thousands of nearly equal vectors permutations tell little, and there the search goes on.
The best K of all blocks are the answer.

Every row is indexed. Only the pivots come from a bounded sample (PIVOTS vectors, those with the
least hash of their id), so what is sent to all tasks has PIVOTS times the dimension values.
Queries and index are both dealt into blocks of bounded size and meet block by block, as the permutations
of one block say nothing about another; a task emits K rows for each of its queries. Identical vectors,
however many, are indexed K + 1 times: with ties going to the smaller id no further copy can be
among the K nearest of any query.

Recall against brute force and the share of exact comparisons are in the README.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length
from most (by the pivots) take no part; components of any finite size are fine, as vectors are scaled by
powers of two before they meet; equal vectors have equal scores, by the same sums in the same order, and
ties go to the smaller vec_id; fewer than K candidates give fewer rows; rows that share a
vec_id are one query and one candidate, by its nearest vector; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import cut

K = 5
PIVOTS = 1024
POSTED = 128
OPENED = 192
REFINED = 0.015
BLOCK = 32_768
QUERY_BLOCK = 16_384
_ROWS = 2_048  # vectors whose distances to the pivots are held at once


def _valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & sound).select(F.col(key).alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def scaled(m: np.ndarray) -> np.ndarray:
    """Every row times the power of two that brings its largest component to 0.5 to 1: no product overflows, no digit is lost in ordinary rows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def permutations(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """(vectors, length): the numbers of the nearest pivots, nearest first. Pivot i + len(pivots) is the opposite of pivot i."""
    length = min(length, 2 * len(pivots))
    out = np.empty((len(vectors), length), np.int16)
    for s in range(0, len(vectors), _ROWS):
        near = vectors[s : s + _ROWS] @ pivots.T
        far = -np.concatenate([near, -near], axis=1)
        first = np.argpartition(far, length - 1, axis=1)[:, :length]
        order = np.argsort(np.take_along_axis(far, first, axis=1), axis=1, kind="stable")
        out[s : s + _ROWS] = np.take_along_axis(first, order, axis=1)
    return out


class Postings:
    """Inverted files of one block: of each pivot, the vectors that have it in their permutation and its place there."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, posted: int):
        seen = permutations(vectors, pivots, posted)
        self.size = len(vectors)
        order = np.argsort(seen.ravel(), kind="stable")
        self.rows = (order // seen.shape[1]).astype(np.int32)
        self.places = (order % seen.shape[1]).astype(np.int16)
        self.starts = np.searchsorted(seen.ravel()[order], np.arange(2 * len(pivots) + 1))

    def gains(self, opened: np.ndarray) -> np.ndarray:
        """Of each vector: the footrule distance of permutations without a common pivot, less that of the vector's to opened."""
        parts = [slice(self.starts[p], self.starts[p + 1]) for p in opened.tolist()]
        rows = np.concatenate([self.rows[s] for s in parts])
        there = np.concatenate([self.places[s] for s in parts]).astype(np.int32)
        here = np.repeat(np.arange(len(opened), dtype=np.int32), [s.stop - s.start for s in parts])
        # a shared pivot at places a and b stands |a - b| apart; in one permutation alone, the places up to the end
        gain = 2 * len(opened) - here - there - np.abs(here - there)
        return np.bincount(rows, weights=gain, minlength=self.size)


def search_block(q_ids, q, ids, m, pivots, k: int, refined: float, posted: int = POSTED, opened: int = OPENED) -> tuple[list[tuple[int, int, float]], int]:
    """([(query, candidate, cosine)], exact comparisons): the k best of one block for each query. ids ascend."""
    if not len(ids) or not len(q_ids):
        return [], 0
    m, q = scaled(m), scaled(q)
    m_norm, q_norm = _norms(m), _norms(q)
    files = Postings(m / m_norm[:, None], pivots, posted)
    asked = permutations(q / q_norm[:, None], pivots, opened)
    start = max(int(len(ids) * refined) + 1, 32 * k)
    out, compared = [], 0
    for i in range(len(q_ids)):
        order = np.argsort((-files.gains(asked[i])).astype(np.int32), kind="stable")  # ties by id: ids ascend
        best: list[tuple[float, int]] = []
        low, high = 0, start
        while low < len(order):
            near = order[low:high]
            near = near[ids[near] != q_ids[i]]
            compared += len(near)
            cos = (m[near] * q[i]).sum(axis=1) / (m_norm[near] * q_norm[i])
            top = np.lexsort((ids[near], -cos))[:k]
            merged = sorted([*best, *((-cos[t], ids[near[t]]) for t in top)])[:k]
            if merged == best:
                break
            best, low, high = merged, high, 2 * high
        out += [(q_ids[i], name, -c) for c, name in best]
    return out, compared


def nearest(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int = PIVOTS, refined: float = REFINED, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors but those of its own id."""
    valid = _valid(vectors, key, vector)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    width = max((len(r.v) for r in sample), key=[len(r.v) for r in sample].count) if sample else 0
    seen = scaled(np.array([r.v for r in sample if len(r.v) == width])) if width else np.empty((0, 0))
    centre = seen / _norms(seen)[:, None] if width else seen

    copies = Window.partitionBy("v").orderBy("vec_id")
    index = cut(valid.where(F.size("v") == width).withColumn("_r", F.dense_rank().over(copies)).where(F.col("_r") <= k + 1).select("vec_id", "v").distinct())
    asked = _valid(queries, key, vector).where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(asked)
    blocks = max(1, -(-index.count() // block))
    q_blocks = max(1, -(-asked.count() // query_block))

    def hashed(n: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    posted = index.withColumn("b", hashed(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    sent = asked.withColumn("qb", hashed(q_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            rows, _ = search_block(left.column("vec_id").to_numpy(), _matrix(left.column("v")), ids[order], _matrix(right.column("v"))[order], centre, k, refined)
        cols = list(zip(*rows)) or [()] * 3
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = sent.groupBy("qb", "b").cogroup(posted.groupBy("qb", "b")).applyInArrow(searched, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
