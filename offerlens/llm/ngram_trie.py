"""Language-model scores from an Elias-Fano n-gram trie.

Training documents are those whose crc32(doc_id as text) mod 10 is not 0. Tokens are the words of
the text with A-Z lower-cased, then one end. Base score: add-0.1 unigrams. Model: interpolation of
trigrams (order 3) with bigrams, and of those with that base,

    P(w | h) = l(c(h)) c(h w) / c(h) + (1 - l(c(h))) P(w | shorter h),

where an end stands before the first word. Weights are fitted on the training counts by leaving one out: l(c) is the share of
training tokens behind contexts of count c (by itself up to 15, then by powers of two) whose n-gram occurs once more. So a
context seen once has weight 0, and what occurs twice is told from what occurs once. As l depends on the
context alone, P sums to one over words, but for the quantising below (0.018 in log10 at most for each level).

N-grams are dealt out by the hash of their first word; those of a word with more than SPLIT training tokens by parts
of its successors, so that no word, however common, meets in one task. Trigrams go with their first two words.

Each shard is a trie of two levels, or three: its contexts, ascending, with monotone pointers to their
successors, and the successors of each context, kept as one monotone sequence by adding to each
range where the one before ended. All three are Elias-Fano coded and stay so, in one anonymous memory map: low bits packed, high
parts as unary bits with a count of ones for every 64 of them. Beside the successors stand the
probabilities c(h w) / c(h), quantised to eight bits on a log scale. A query finds its context by
selecting the context's high part and searching among the low bits, then its range by the pointers, then its successor
relative to that range. The third level hangs below the successors by their numbers.

Documents are held in blocks. A block asks word shards for the ids and counts of its distinct words
and n-gram shards for the codes of its distinct bigrams and of what follows each; questions follow the distinct words
and n-grams of blocks, and messages are at most FAN for each block and hop (routing). What is gathered is the
corpus' own counts, all of them.

Defined cases: a null text is empty and has the end alone; a null doc_id is held out; repeated rows
count as often as they stand there; texts of any length are scored whole; an empty table gives no
rows; without training tokens every base probability is that of an unseen token; extra columns are
ignored. Held-out words that training lacks have count 0. Word ids stay below 2^32 (distinct words).
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.byte_blocks import BLOCK_BYTES, cut_by, expand, mixed, named_rows, pack_ints, squeeze, unpack_ints
from offerlens.llm.common import id_and_bytes
from offerlens.llm.routing import FAN, MESSAGE, Items, Net, answer_of, ask, converse, ranges, starts, summed, table

SMOOTH = 0.1
#: Training tokens of a word from which its bigrams are dealt out in parts.
SPLIT = 50_000
#: Classes of context counts: 0 to 15 one by one, then by powers of two.
CLASSES = 64
#: Words hold no space, so this is none.
END = b" "
SHARD_BYTES = 8 << 20
FOLDS = 10
#: Codes 1..255 cover log10 probabilities from -LOG_SPAN to 0 evenly; 0 stands for none.
LOG_SPAN = 9.0


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


# -- Elias-Fano ------------------------------------------------------------------------------------


_ONE = np.uint64(1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as words of 64, and one word more."""
    out = np.zeros(len(bits) // 64 + 2, "<u8")
    data = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(data)] = data
    return out


#: The place of the k-th set bit of each byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _NIBBLES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit of each word: the byte by sums of bits over its bytes, then the bit by table."""
    n = n.astype(np.uint64)
    x = words - ((words >> _ONE) & _FIVES)
    x = (x & _THREES) + ((x >> np.uint64(2)) & _THREES)
    upto = ((x + (x >> np.uint64(4))) & _NIBBLES) * _EACH
    byte = np.bitwise_count((((n * _EACH) | _HIGH) - upto) & _HIGH).astype(np.uint64) << np.uint64(3)
    before = ((upto << np.uint64(8)) >> byte) & np.uint64(255)
    return byte.astype(np.int64) + _IN_BYTE[(words >> byte) & np.uint64(255), n - before]


def _window(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each place on."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    return (bits[word] >> shift) | np.where(shift > 0, bits[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))


def _first_bit(words: np.ndarray) -> np.ndarray:
    """The place of the first set bit of each word, 64 if there is none."""
    return np.bitwise_count((words & (~words + _ONE)) - _ONE).astype(np.int64)


class EliasFano:
    """An ascending sequence: low bits packed, high parts as unary bits (a one for each value, a zero after each high part)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        """ones: how many ones there are before each word of high."""
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(n * low_bits, np.uint8)
        for k in range(low_bits):
            low[k::low_bits] = (values >> np.uint64(k)) & _ONE
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 2 if n else 1, np.uint8)
        unary[ones] = 1
        high = _packed(unary)
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, low_bits, _packed(low), high, np.cumsum(counts) - counts)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], "<i8"), self.low, self.high, self.ones]

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        return _window(self.low, at * self.low_bits) & np.uint64((1 << self.low_bits) - 1)

    def _value(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _one(self, at: np.ndarray) -> np.ndarray:
        """The place of each one among the unary bits."""
        word = np.searchsorted(self.ones, at, "right") - 1
        return 64 * word + _nth_bit(self.high[word], at - self.ones[word])

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the places."""
        return self._value(at, self._one(at))

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places and those behind them."""
        place = self._one(at)
        step = _first_bit(_window(self.high, place + 1))
        later = place + 1 + step
        if len(far := np.flatnonzero(step > 63)):
            later[far] = self._one(at[far] + 1)
        return self._value(at, place), self._value(at + 1, later)

    def _behind(self, high: np.ndarray) -> np.ndarray:
        """How many values have at most that high part: by selecting the zero."""
        word = np.searchsorted(self.zeros, high, "right") - 1
        return 64 * word + _nth_bit(~self.high[word], high - self.zeros[word]) - high

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The places of values, -1 where they aren't among those from first up to last."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        live = np.flatnonzero(values <= self.access(np.array([self.n - 1]))[0])
        high, low = (values[live] >> np.uint64(self.low_bits)).astype(np.int64), values[live] & np.uint64((1 << self.low_bits) - 1)
        begin = np.zeros(len(live), np.int64)
        inner = np.flatnonzero(high)
        begin[inner] = self._behind(high[inner] - 1)
        many = _first_bit(~_window(self.high, begin + high))  # ones up to the next zero
        end = begin + many
        if len(far := np.flatnonzero(many > 63)):
            end[far] = self._behind(high[far])
        if first is not None:
            begin, end = np.maximum(begin, first[live]), np.minimum(end, last[live])
        stop = end.copy()
        open_ = np.flatnonzero(end - begin > 1)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            upper = self._low(middle) <= low[open_]
            begin[open_] = np.where(upper, middle, begin[open_])
            end[open_] = np.where(upper, end[open_], middle)
            open_ = open_[end[open_] - begin[open_] > 1]
        here = np.flatnonzero(begin < stop)
        here = here[self._low(begin[here]) == low[here]]
        out[live[here]] = begin[here]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0."""
    place = (np.log10(np.maximum(p, 1e-300)) + LOG_SPAN) / LOG_SPAN
    return (1 + np.rint(np.clip(place, 0, 1) * 254)).astype(np.uint8)


def log10_of(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.float64) - 1) / 254 * LOG_SPAN - LOG_SPAN


class Trie:
    """Two levels over sorted n-grams: contexts with pointers, successors relative to them with codes; memory-mapped."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray):
        """contexts and words: equally long, sorted by context and then word, no repeats."""
        first = starts(contexts)
        pointers = np.append(first, len(contexts))
        self.step = np.uint64(int(words.max()) + 1 if len(words) else 1)
        rank = np.repeat(np.arange(len(first)), np.diff(pointers)).astype(np.uint64)
        levels = [EliasFano.build(contexts[first]), EliasFano.build(pointers), EliasFano.build(words.astype(np.uint64) + rank * self.step)]
        arrays = [a for level in levels for a in level.parts()] + [codes]
        self._map = mmap.mmap(-1, max(1, sum(a.nbytes for a in arrays)))
        at, views = 0, []
        for a in arrays:
            self._map[at : at + a.nbytes] = np.ascontiguousarray(a).tobytes()
            views.append(np.frombuffer(self._map, a.dtype, len(a), at))
            at += a.nbytes
        self.n_bytes = at
        self.contexts, self.pointers, self.successors = (EliasFano(int(views[k][0]), int(views[k][1]), *views[k + 1 : k + 4]) for k in (0, 4, 8))
        self.codes = views[12]

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 where it is not in the trie."""
        return self.codes_at(self.places(contexts, words))

    def codes_at(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.codes[places], np.uint8(0)) if len(self.codes) else np.zeros(len(places), np.uint8)

    def places(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The number of each n-gram among those of the trie, -1 where it is not in it."""
        out = np.full(len(contexts), -1, np.int64)
        begin = starts(contexts)  # equal contexts that follow one another are found once
        rank = self.contexts.find(contexts[begin])
        known = np.flatnonzero(rank >= 0)
        many = np.diff(np.append(begin, len(contexts)))[known]
        hit = ranges(begin[known], many)
        if len(hit):
            first, last = (np.repeat(x.astype(np.int64), many) for x in self.pointers.pairs(rank[known]))
            rank = np.repeat(rank[known].astype(np.uint64), many)
            inside = np.flatnonzero(words[hit] < self.step)
            hit = hit[inside]
            out[hit] = self.successors.find(words[hit] + rank[inside] * self.step, first[inside], last[inside])
        return out


def class_of(counts: np.ndarray) -> np.ndarray:
    """Classes of context counts."""
    return np.where(counts < 16, counts, 12 + np.floor(np.log2(np.maximum(counts, 1)))).astype(np.int64)


# -- blocks of tokens ------------------------------------------------------------------------------

TOKENS = "block long, n_train long, n_bytes long, ids binary, sizes binary, tokens binary, words binary, named binary"


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list[int | None] = []
    sizes: list[int] = []
    tokens: list[int] = []
    number = _Numbers({END: 0})
    held = made = 0

    def row() -> pa.RecordBatch:
        local = np.array(tokens, np.int64)
        order = np.argsort(-np.bincount(local, minlength=len(number)), kind="stable")  # small numbers for frequent words
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        words = list(number)
        train = sum(n for key, n in zip(ids, sizes) if not is_held_out(key))
        cells = [first + made, train, held, np.array([k or 0 for k in ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), pack_ints(new[local]), squeeze(b"\n".join([words[i] for i in order.tolist()]))]
        cells.append(np.packbits([k is not None for k in ids]).tobytes())
        types = [*[pa.int64()] * 3, *[pa.binary()] * 5]
        names = ["block", "n_train", "n_bytes", "ids", "sizes", "tokens", "words", "named"]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types)], names=names)

    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = bytes(body.as_buffer()).lower().split()
            ids.append(key)
            sizes.append(len(text) + 1)
            tokens += map(number.__getitem__, text)
            tokens.append(0)
            held += body.as_buffer().size
            if held >= BLOCK_BYTES or len(ids) >= 50_000:
                yield row()
                ids, sizes, tokens, number, held, made = [], [], [], _Numbers({END: 0}), 0, made + 1
    if ids:
        yield row()


class _Block:
    def __init__(self, row: dict):
        self.ids = [k if named else None for k, named in zip(np.frombuffer(row["ids"], "<i8").tolist(), named_rows(row))]
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.tokens = unpack_ints(row["tokens"]).astype(np.int64)
        self.words = expand(row["words"]).split(b"\n")
        self.held_out = np.array([is_held_out(k) for k in self.ids], bool)

    def train_counts(self) -> np.ndarray:
        weight = np.repeat(~self.held_out, self.sizes).astype(np.float64)
        return np.bincount(self.tokens, weights=weight, minlength=len(self.words)).astype(np.int64)

    def shards_of_words(self, net: Net) -> tuple[np.ndarray, np.ndarray]:
        """(order of the words by shard, their shards in that order)."""
        shard = net.shard_of(np.array([zlib.crc32(w) for w in self.words], np.uint64), 32)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]

    def global_words(self, answers: pa.Table, net: Net) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of every local word."""
        told = answer_of(answers, 2, 0).dense
        ids, counts = np.empty(len(self.words), np.uint64), np.empty(len(self.words), np.int64)
        order, _ = self.shards_of_words(net)
        ids[order], counts[order] = told
        return ids, counts

    def bigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct bigrams as two 32-bit ids in one, ascending; of each token, behind an end if it is a document's first, the number of its bigram)."""
        known = ids[self.tokens]
        pairs = (known[self.before()] << np.uint64(32)) | known
        return np.unique(pairs, return_inverse=True)

    def before(self) -> np.ndarray:
        """Where the token before each stands; for the first of a document, where some end stands."""
        at = np.arange(len(self.tokens)) - 1
        ends = np.cumsum(self.sizes)
        at[ends - self.sizes] = ends[0] - 1
        return at

    def trigrams(self, ids: np.ndarray, number: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct trigrams as the number of the bigram before and a 32-bit id, ascending; the number of its trigram for each token but the first of a document; where those tokens are); none for order two."""
        later = np.ones(len(self.tokens), bool)
        later[np.cumsum(self.sizes) - self.sizes] = False
        at = np.flatnonzero(later) if order > 2 else np.empty(0, np.int64)
        keys = (number[at - 1].astype(np.uint64) << np.uint64(32)) | ids[self.tokens[at]]
        distinct, third = np.unique(keys, return_inverse=True)
        return distinct, third, at

    def above(self, distinct: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The count of each bigram's first word."""
        by_id = np.argsort(ids)
        return counts[by_id[np.searchsorted(ids[by_id], distinct >> np.uint64(32))]]

    def questions(self, distinct: np.ndarray, thirds: np.ndarray, above: np.ndarray, net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the bigrams by shard, their shards in that order, how many trigrams go on from each bigram). above: count of each bigram's first word."""
        first, second = distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF)
        parts = 1 + above.astype(np.uint64) // np.uint64(SPLIT)
        shard = net.shard_of(mixed(mixed(first + _ONE) + mixed(second + _ONE) % parts) >> np.uint64(16))
        order = np.argsort(shard, kind="stable")
        return order, shard[order], np.bincount((thirds >> np.uint64(32)).astype(np.int64), minlength=len(distinct))


def _ask_words(net: Net):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                counts = block.train_counts()
                order, shard = block.shards_of_words(net)
                words = [block.words[i] for i in order.tolist()]
                letters = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
                items = Items([counts[order].astype(np.uint64)], np.array([len(w) + 1 for w in words], np.int64), [letters])
                yield from table(list(ask(net, row["block"], shard, items))).to_batches()

    return asked


def _answer_words(shards: int):
    def answer(shard: int, items: Items) -> tuple[Items, list[int]]:
        """(id, count) of each word; and how many words there are in training."""
        number = _Numbers()
        at = np.array(list(map(number.__getitem__, items.ragged[0].tobytes().split(b"\n")[:-1])), np.int64)
        total = np.bincount(at, weights=items.dense[0].astype(np.float64), minlength=len(number)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids = (rank * shards + shard).astype(np.uint64)
        if len(ids) and int(ids.max()) >> 32:
            raise ValueError("more than 2^32 distinct words")
        return Items([ids[at], total[at].astype(np.uint64)]), [int((total > 0).sum())]

    return answer


def _unigram(counts: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return (counts + SMOOTH) / (tokens + SMOOTH * (types + 1))


def _ask_ngrams(word_net: Net, net: Net, order: int):
    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in mine.to_pylist():
            block = _Block(row)
            ids, counts = block.global_words(answers, word_net)
            distinct, number = block.bigrams(ids)
            owner = np.repeat(~block.held_out, block.sizes)
            n = np.bincount(number, weights=owner, minlength=len(distinct)).astype(np.uint64)
            thirds, third, at = block.trigrams(ids, number, order)
            m = np.bincount(third, weights=owner[at], minlength=len(thirds)).astype(np.uint64)
            above = block.above(distinct, ids, counts)
            deal, shard, followers = block.questions(distinct, thirds, above, net)
            items = Items([distinct >> np.uint64(32), distinct & np.uint64(0xFFFFFFFF), n, above.astype(np.uint64)], followers, [thirds & np.uint64(0xFFFFFFFF), m])
            out += ask(net, row["block"], shard, items.take(deal))
        return table(out)

    return send


def _level(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, context_counts: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray]:
    """(trie of the n-grams that have counts, the place of each question in it, the count of each place, [training tokens and those whose n-gram occurs once] by class)."""
    key = (contexts << np.uint64(32)) | words
    order = np.argsort(key, kind="stable")
    begin = starts(key[order])
    sums = np.add.reduceat(counts[order].astype(np.int64), begin) if len(begin) else np.empty(0, np.int64)
    seen = np.flatnonzero(sums > 0)
    key, of = key[order[begin]], context_counts[order[begin]].astype(np.int64)
    total, of_seen = sums[seen], of[seen]
    trie = Trie(key[seen] >> np.uint64(32), key[seen] & np.uint64(0xFFFFFFFF), quantise(total / np.maximum(of_seen, 1)))
    places = np.empty(len(order), np.int64)
    places[order] = np.repeat(trie.places(key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)), np.diff(np.append(begin, len(order))))
    of_class = class_of(of_seen)
    stats = np.stack([np.bincount(of_class, weights=w, minlength=CLASSES).astype(np.int64) for w in (total, total == 1)])
    return trie, places, total, stats


def _answer_ngrams(shard: int, items: Items) -> tuple[Items, list[int]]:
    """(code, class of its count) of each bigram, the codes of what follows it; and both levels' sums for the weights."""
    contexts, words, counts, above = items.dense
    trie, places, total, stats = _level(contexts, words, counts, above)
    codes = trie.codes_at(places)
    count = np.where(places >= 0, total[places], 0) if len(total) else np.zeros(len(places), np.int64)
    over = np.repeat(places, items.times)
    known = np.flatnonzero(over >= 0)
    third_codes = np.zeros(len(over), np.uint8)
    trie, at, _, third_stats = _level(over[known].astype(np.uint64), items.ragged[0][known], items.ragged[1][known], total[over[known]] if len(total) else over[known])
    third_codes[known] = trie.codes_at(at)
    return Items([codes, class_of(count).astype(np.uint8)], items.times, [third_codes]), [*stats.ravel().tolist(), *third_stats.ravel().tolist()]


def fitted(sums: list[int]) -> np.ndarray:
    """(levels, classes): the weight of contexts of each class, from the sums over all shards."""
    tokens, once = np.array(sums or [0] * 4 * CLASSES, np.float64).reshape(2, 2, CLASSES).transpose(1, 0, 2)
    return (tokens - once) / (tokens + 1)  # below 1, as something unseen may always come


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(word_net: Net, net: Net, tokens: int, types: int, order: int, weights: np.ndarray):
    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for row in mine.to_pylist():
            block = _Block(row)
            of_words = answers.filter(answers.column("words"))
            of_ngrams = answers.filter(pc.invert(answers.column("words")))
            ids, counts = block.global_words(of_words, word_net)
            distinct, number = block.bigrams(ids)
            thirds, third, at = block.trigrams(ids, number, order)
            deal, _, followers = block.questions(distinct, thirds, block.above(distinct, ids, counts), net)
            told = answer_of(of_ngrams, 2, 1)
            back = np.empty(len(deal), np.int64)
            back[deal] = np.arange(len(deal))
            told = told.take(back)
            (codes, classes), third_codes = told.dense, told.ragged[0]
            c = counts[block.tokens]
            p1 = _unigram(c, tokens, types)
            w = weights[0][class_of(counts[block.tokens[block.before()]])]
            p = w * _probability(codes[number]) + (1 - w) * p1
            w = weights[1][classes[number[at - 1]]] if len(at) else np.empty(0)
            p[at] = w * _probability(third_codes[third]) + (1 - w) * p[at]
            firsts = np.cumsum(block.sizes) - block.sizes
            sums = [np.add.reduceat(x, firsts) for x in ((c > 0).astype(np.int64), np.log10(p1), np.log10(p))]
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held_out),
                        "n_tokens": pa.array(block.sizes), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[x.split()[0] for x in SCORES.split(", ")])

    return score


def _probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** log10_of(codes), 0.0)


def score(docs: DataFrame, order: int = 2, fan: int = FAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs, by bigrams (order 2) or trigrams (order 3)."""
    whole = cut_by(id_and_bytes(docs).mapInArrow(_tokenise, TOKENS), "block")
    sums = whole.agg(F.sum("n_bytes").alias("b"), F.sum("n_train").alias("t"), F.count("*").alias("n")).head()
    tokens, shards = sums.t or 0, max(1, -(-(sums.b or 0) // shard_bytes))
    word_net, net = Net(max(1, shards // 4), sums.n, fan), Net(shards, sums.n, fan)
    words = converse(whole.mapInArrow(_ask_words(word_net), MESSAGE), _answer_words(word_net.shards), word_net, (1, 1), (2, 0), written=True)
    types = sum(summed(words))
    asked = whole.groupBy("block").cogroup(words.groupBy("to")).applyInArrow(_ask_ngrams(word_net, net, order), MESSAGE)
    ngrams = converse(asked, _answer_ngrams, net, (4, 2), (2, 1), written=True)
    weights = fitted(summed(ngrams))
    back = words.select("to", "frm", "items", F.lit(True).alias("words")).union(ngrams.select("to", "frm", "items", F.lit(False)))
    scored = whole.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_score(word_net, net, tokens, types, order, weights), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
