"""Spelling variants: every word's neighbours at one edit, and the frequent neighbour that it is probably meant for.

Words are maximal runs of letters up to U+00FF, A-Z in lower case; some are damaged on purpose (one letter deleted, chosen by a
checksum of document and run), so that there are variants whose form is known. Words of LEAST letters and TIMES occurrences count.

1. Counts: the runs of every text are counted by Spark, summed by task before they are shuffled.
2. Trie shards. The words are numbered in order, range by range; SHARD consecutive words make one trie, kept compactly: for every
   node the place of its first edge, for every edge its letter and target, for every end its count.
3. Search. WAVE shards at a time are broadcast: their size is bounded by SHARD and WAVE, whatever the vocabulary's. Each task has
   its own words, intersects their distance-one Levenshtein automata with every shard and keeps for each word the number of
   accepting neighbours and the best of them. The states (word, node, letters read, edit done or not) of many words are
   one numpy array; arrays wait on a stack, the one made last is taken first, so the walk is depth-first
   and the stack stays small.
4. The waves' counts and best forms are reduced by word. Roots follow forms by pointer doubling: a form is FACTOR times as
   frequent as its word, so chains are as long as the logarithm of the largest count at most, and no join has a hot
   key, as a form has no more variants than there are single edits of it.

Defined cases: a null text has no words; runs of documents without a doc_id are not damaged; repeated rows count as often as
they stand there; a word without a near one has n_near 0, no form, and is its own root; runs of any length count; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.byte_blocks import pack_ints, unpack_ints
from offerlens.llm.common import cut, numbered, shuffle_partitions

LEAST = 6
TIMES = 5
FACTOR = 5
DAMAGED = 199
#: Words of a trie shard, and shards that are broadcast at a time (some MB each at most for words of common length).
SHARD = 32_768
WAVE = 16
#: States of the automata that are expanded at a time.
STATES = 1 << 16
BATCH = 8_192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = LEAST, times: int = TIMES, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the words that count, and how often they occur. A run shorter than a word can't become one."""
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), 0)).alias("raw"))
    lowered = runs.select("id", F.when(F.col("raw").rlike("[A-Z]"), F.translate("raw", _UPPER, _LOWER)).otherwise(F.col("raw")).alias("run"))
    summed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return summed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


# -- tries -----------------------------------------------------------------------------------------


def _ragged(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words, where each begins and the last ends): letters are at most U+00FF, so one byte each."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8), ends


class Trie:
    """A trie of ascending words. Nodes are numbered as they are met; node 0 is the root.

    edges: for each node the place of its first edge (and one more at the end); letter, target: of each edge, ascending by node
    and letter; ends: the number of the word that ends at each node, or -1; counts: of the words.
    """

    def __init__(self, edges: np.ndarray, letter: np.ndarray, target: np.ndarray, ends: np.ndarray, counts: np.ndarray, texts: list[str]):
        self.edges, self.letter, self.target, self.ends, self.counts, self.texts = edges, letter, target, ends, counts, texts
        self.keys = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * 256 + letter

    @classmethod
    def build(cls, texts: list[str], counts: np.ndarray) -> Trie:
        parent, letter, ends, path = [], [], [-1], [0]
        before = ""
        for k, text in enumerate(texts):
            shared, most = 0, min(len(before), len(text))
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del path[shared + 1 :]
            for c in text[shared:]:
                parent.append(path[-1])
                letter.append(ord(c))
                ends.append(-1)
                path.append(len(parent))
            ends[path[-1]] = k
            before = text
        up, letters = np.array(parent, np.int64), np.array(letter, np.int64)
        order = np.argsort(up * 256 + letters)
        edges = np.searchsorted(up[order], np.arange(len(ends) + 1))
        return cls(edges, letters[order], order + 1, np.array(ends, np.int64), counts.astype(np.int64), texts)

    def cells(self) -> list[bytes]:
        """The trie as it is broadcast: its words are read off the path of each node, so the texts aren't sent."""
        return [pack_ints(x.astype(np.uint64)) for x in (self.edges, self.letter, self.target, self.ends + 1, self.counts)]

    @classmethod
    def load(cls, cells: list[bytes]) -> Trie:
        edges, letter, target, ends, counts = (unpack_ints(bytes(c)).astype(np.int64) for c in cells)
        nodes = len(edges) - 1
        up, by = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        up[target], by[target] = np.repeat(np.arange(nodes), np.diff(edges)), letter
        up, by, ends = up.tolist(), by.tolist(), ends - 1
        texts = [""] * len(counts)
        for node, k in zip(np.flatnonzero(ends >= 0).tolist(), ends[ends >= 0].tolist()):
            chars = []
            while node:
                chars.append(by[node])
                node = up[node]
            texts[k] = bytes(reversed(chars)).decode("latin-1")
        return cls(edges, letter, target, ends, counts, texts)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node behind that letter, or -1."""
        key = node * 256 + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.target[at], -1)

    def near(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, neighbour) pairs, each once: which words of the trie are exactly one edit away from each word."""
        many = len(begin)
        found = []
        first = np.arange(many)
        stack = [(first[a : a + STATES], np.zeros(len(first[a : a + STATES]), np.int64), np.zeros(len(first[a : a + STATES]), np.int64), False) for a in range(0, many, STATES)]

        def push(word: np.ndarray, node: np.ndarray, read: np.ndarray, edited: bool) -> None:
            for a in range(0, len(word), STATES):
                stack.append((word[a : a + STATES], node[a : a + STATES], read[a : a + STATES], edited))

        while stack:
            word, node, read, edited = stack.pop()
            open_ = read < length[word]
            if edited:  # what is left must be read letter by letter
                done = ~open_ & (self.ends[node] >= 0)
                found.append(word[done] * (1 << 32) + self.ends[node[done]])
                w, r = word[open_], read[open_]
                to = self.child(node[open_], flat[begin[w] + r])
                on = to >= 0
                push(w[on], to[on], r[on] + 1, True)
                continue
            w, v, r = word[open_], node[open_], read[open_]
            letter = flat[begin[w] + r].astype(np.int64)
            push(w, v, r + 1, True)  # the trie's word lacks this letter
            times = self.edges[node + 1] - self.edges[node]
            every = np.repeat(np.arange(len(node)), times)
            edge = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times) + self.edges[node[every]]
            push(word[every], self.target[edge], read[every], True)  # it has one more
            rest = np.flatnonzero(open_[every])
            spot = every[rest]
            other = self.letter[edge[rest]] != flat[begin[word[spot]] + read[spot]]
            push(word[spot[other]], self.target[edge[rest[other]]], read[spot[other]] + 1, True)  # it has another
            to = self.child(v, letter)
            on = to >= 0
            push(w[on], to[on], r[on] + 1, False)
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs >> 32, pairs & ((1 << 32) - 1)


def _built(part: pa.Table) -> pa.Table:
    part = part.sort_by("i")
    texts = part.column("word").to_pylist()
    trie = Trie.build(texts, part.column("n").to_numpy())
    return pa.table({"shard": part.column("shard")[:1], "cells": pa.array([trie.cells()], pa.list_(pa.binary()))})


def shards(vocabulary: DataFrame, size: int = SHARD) -> DataFrame:
    """(shard, cells): tries of `size` consecutive words each; shards are numbered from 0 in the words' order."""
    placed = numbered(vocabulary.select(F.lit(0).alias("all"), "word", "n"), "all", ("word",), count="total")
    cut_up = placed.select(F.expr(f"i div {size}").alias("shard"), "i", "word", "n")
    return cut_up.groupBy("shard").applyInArrow(_built, "shard long, cells array<binary>")


#: Tries of the wave that this process loaded last, by the wave's own name.
_LOADED: dict[str, list[Trie]] = {}


def _searched(wave: str, sent):
    """Of the words of a task: (word, n_near, form_n, form) over the shards of the wave; form is the best, not yet held against FACTOR."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wave not in _LOADED:
            _LOADED.clear()
            _LOADED[wave] = [Trie.load(cells) for cells in sent.value]
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                texts = batch.column(0)[a : a + BATCH].to_pylist()
                flat, at = _ragged(texts)
                near, best, form = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [None] * len(texts)
                for trie in _LOADED[wave]:  # ascending, and so are the words within: of equal counts the first stays
                    word, other = trie.near(flat, at[:-1], np.diff(at))
                    near += np.bincount(word, minlength=len(texts))
                    n = trie.counts[other]
                    order = np.lexsort((other, -n, word))
                    lead = order[np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0]))] if len(order) else order
                    for k in lead[n[lead] > best[word[lead]]].tolist():
                        best[word[k]], form[word[k]] = n[k], trie.texts[other[k]]
                hit = np.flatnonzero(near)
                if len(hit):
                    yield pa.record_batch([pa.array([texts[k] for k in hit]), pa.array(near[hit]), pa.array(best[hit]), pa.array([form[k] for k in hit], pa.string())], names=["word", "n_near", "form_n", "form"])

    return search


def variants(docs: DataFrame, shard: int = SHARD, wave: int = WAVE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word that counts."""
    spark = docs.sparkSession
    vocabulary = cut(words(docs))
    tries = cut(shards(vocabulary, shard))
    many = tries.count()
    mine = cut(vocabulary.select("word").repartition(shuffle_partitions(spark), "word"))
    parts = None
    for low in range(0, many, wave):
        held = tries.where((F.col("shard") >= low) & (F.col("shard") < low + wave)).orderBy("shard").collect()
        sent = spark.sparkContext.broadcast([[bytes(c) for c in r.cells] for r in held])
        part = cut(mine.mapInArrow(_searched(uuid.uuid4().hex, sent), "word string, n_near long, form_n long, form string"))
        sent.destroy()
        parts = part if parts is None else parts.union(part)
    if parts is None:
        parts = spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    reduced = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
    judged = vocabulary.join(reduced, "word", "left")
    meant = -F.col("best.m") >= FACTOR * F.col("n")
    formed = cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(meant, F.col("best.form")).alias("form"), F.when(meant, -F.col("best.m")).alias("form_n")))
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:  # a chain halves with each turn
        further = up.select(F.col("word").alias("to"), F.col("to").alias("then"))
        up = cut(up.join(further, "to", "left").select("word", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            break
        up = up.select("word", "to")
    roots = up.select("word", F.col("to").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
