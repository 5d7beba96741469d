"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most SIZE tokens. What to pack together depends on lengths
alone, and there are SIZE lengths at most, so the plan is made on the table of how many pieces have
each length (its size doesn't grow with the data) and holds patterns, each a list of lengths and how
often it is used. From the longest length down, the gap that a piece leaves is looked up among
single lengths, sums of pairs and sums of triples under the counts still available; a combination
that fills it exactly is consumed as often as the counts allow. What has no exact complement takes
the longest piece that fits and looks again. Each pattern uses up a length or all but a rest of it,
so there are a few thousand patterns at most.

Pieces then find their places without any grouping: a piece's rank among those of its length (counts
per salt, summed up, plus the rank within length and salt, so that a common length is split) falls
into one range of the plan, which gives its sequence and offset.

Defined cases: a null or blank text is the closing id alone; a document longer than SIZE tokens is
cut every SIZE tokens, the last piece may be shorter; rows that share a doc_id are packed one by
one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import cut, id_and_bytes

SIZE = 2048
CLOSING = 0
MEMO = 400_000
#: Documents that are encoded together.
GROUP = 256
#: Pieces of one length and salt that one task ranks, about.
RANKED = 500_000
TOKENIZER = "word_bpe_49k.json"
#: Letters that are in normal form and lower case as they stand.
_LATIN = re.compile(r"([a-zß-öø-ÿ]+)([.,]?)")


class Encoder:
    """Token ids of a whole text, word by word: this tokenizer drops white space and never looks across it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.packed = [struct.Struct(f"<{n}I").pack for n in range(32)]
        self.memo: dict[bytes, bytes] = {}
        # the tokenizer's letters for the bytes of accented characters, and the ids of the two marks
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.marks = {x: np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("", ".", ",")}
        self.closing = np.array([CLOSING], "<u4").tobytes()

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. A run of lower-case Latin letters, and a stop or comma behind it, needs no normalizing: the merges alone give its ids."""
        out: dict[bytes, bytes] = {}
        whole: list[bytes] = []
        merge, packed, marks = self.tokenizer.model.tokenize, self.packed, self.marks
        for w in words:
            if m := _LATIN.fullmatch(text := w.decode("utf-8", "replace")):
                core = m[1] if m[1].isascii() else m[1].encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in merge(core)]
                out[w] = (packed[len(ids)](*ids) if len(ids) < len(packed) else np.array(ids, "<u4").tobytes()) + marks[m[2]]
            else:
                whole.append(w)
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            for w, e in zip(part, coded):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, bodies: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each body and the closing id; what is new is encoded for all of them at once."""
        # its lower case is the tokenizer's own; only the strings of special tokens tell cases apart
        listed = [(b if b"<|" in b else b.lower()).split() for b in bodies]
        memo = self.memo
        found = [list(map(memo.get, words)) for words in listed]
        open_ = [k for k, parts in enumerate(found) if None in parts]
        missing = {w for k in open_ for w, x in zip(listed[k], found[k]) if x is None}
        new = self._new(list(missing)) if missing else {}
        if len(memo) < MEMO:
            memo.update((w, x) for w, x in new.items() if len(w) < 48)
        for k in open_:
            found[k] = [new[w] if x is None else x for w, x in zip(listed[k], found[k])]
        return [b"".join(parts) + self.closing for parts in found]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            rows = []
            for low in range(0, batch.num_rows, GROUP):
                group = batch.slice(low, GROUP)
                for key, coded in zip(group.column(0).to_pylist(), code.ids([bytes(b.as_buffer()) for b in group.column(1)])):
                    ids = memoryview(coded)
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_bytes(docs).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """Exact fills of a gap, by an index of the sums that available lengths make, singly, in pairs and in triples.

    pairs: of each sum the lower parts of its pairs; triples: of each sum the parts that leave the sum of a pair, listed when the sum is first
    asked for. Both are stacks with the smallest part on top. Counts only fall, so what is used up is taken off for good.
    """

    def __init__(self, counts: list[int]):
        self.n = counts
        self.lengths = np.array([x for x, n in enumerate(counts) if n and x], np.int64)
        low, high = (self.lengths[k] for k in np.triu_indices(len(self.lengths)))
        sums = low + high
        within = sums < len(counts)
        order = np.lexsort((-low[within], sums[within]))
        low, sums = low[within][order], sums[within][order]
        edges = np.searchsorted(sums, np.arange(len(counts) + 1))
        self.pairs = [low[a:b].tolist() for a, b in zip(edges, edges[1:])]
        self.triples: dict[int, list[int]] = {}

    def has(self, lengths: tuple[int, ...]) -> bool:
        return all(self.n[x] >= lengths.count(x) for x in lengths)

    def pair(self, gap: int, beside: int = 0) -> tuple[int, ...] | None:
        """Two available lengths of that sum, the smallest lower part first; beside a third one if given."""
        stack = self.pairs[gap]
        while stack and not self.has((gap - stack[-1], stack[-1])):
            stack.pop()
        for low in reversed(stack):
            found = (gap - low, low, beside) if beside else (gap - low, low)
            if self.has(found):
                return found
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap not in self.triples:
            self.triples[gap] = [x for x in reversed(self.lengths.tolist()) if x < gap and self.pairs[gap - x]]
        stack = self.triples[gap]
        while stack:
            if self.n[stack[-1]] and (found := self.pair(gap - stack[-1], stack[-1])):
                return found
            stack.pop()
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if self.n[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that uses every piece."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] = n
    find, out = Complements(left), []
    for length in range(size, 0, -1):
        while left[length]:
            pattern = [length]
            left[length] -= 1
            gap = size - length
            while gap:
                if more := find.exact(gap):
                    pattern += more
                    for x in more:
                        left[x] -= 1
                    break
                fit = next((x for x in range(min(gap, length), 0, -1) if left[x]), 0)
                if not fit:
                    break
                pattern.append(fit)
                left[fit] -= 1
                gap -= fit
            need = {x: pattern.count(x) for x in pattern}
            more_times = min(left[x] // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * more_times
            out.append((tuple(pattern), 1 + more_times))
    return out


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Of every slot of the plan: length, first rank, first sequence, offset; sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    cut_up = cut(pieces(docs, path, size))
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most `size` rows
    lengths, ranks, sequences, offsets = _ranges(plan(counts, size))

    salts = max(16, sum(counts.values()) // RANKED)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    starts = cells.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(starts, ["length", "salt"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (lengths << 44) + ranks
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            cols = [*batch.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.record_batch(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
