"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A word goes if a window of WINDOW consecutive words covers it whose words also start, as a window, in a document with
a smaller doc_id. The suffix trees are read WINDOW words deep: what lies deeper only splits repeats that have been found, and a
repeat of any length is covered by the windows along it.

1. Sparse suffixes. In every window the SEED-word string of the least hash is its seed; equal windows have equal seeds at the same
   place. So it is enough to deal out the suffixes that begin at seeds (two in nine), each with the words left and right of it
   that its windows span: a fragment of WINDOW to WINDOW + SPAN - 1 words.
2. Prefixes. Fragments are dealt out by the first words of their seed's suffix. A prefix that more than a group's share of them have is
   lengthened from 1 to 2, 4 and SEED words; beyond that each window goes alone, by all its words, and equal ones are one node.
   Counts are summed by task, and small ones let go within an error bound, before they meet; the prefixes to be lengthened, which every
   task is told, are 2 * MOST_PREFIXES of a length at most (8 bytes each), whatever the corpus' size.
3. Candidates. Blocks of documents ask shards which of their distinct seeds another document has as well. Windows of other seeds
   occur in one document alone and are not sent.
4. Subtrees. Blocks send each distinct fragment once, with the least and the greatest doc_id that have it, to the shard of its
   prefix. A shard collapses equal fragments, numbers their words, sorts the suffixes at which windows begin by those numbers and takes
   the longest common prefix of neighbours: their intervals are the internal nodes of its subtrees. A node of
   depth WINDOW is a repeat; the least doc_id below it goes back with each of its windows.
5. Marks. Blocks mark the windows whose least doc_id is smaller than their own document's, join overlapping ones to maximal
   repeats, and hash the words that are left.

Words are compared as bytes: hashes only choose what meets where and stand for a word until the bytes have been held against those of
the word that they stand for. Blocks and shards talk over hops of bounded fan-out (routing), so messages
are at most FAN for each block and hop. A passage that many documents share is one fragment of each block that has it.

Defined cases: a null text is empty; a null doc_id is the largest, no smaller than any other; rows that share a doc_id are copies of one
document and don't repeat each other; texts of any length and words of any length are whole; an empty table gives
no rows; extra columns are ignored. Documents of fewer than WINDOW words keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.byte_blocks import NO_ID, blocks, mixed, named_rows, open_block
from offerlens.llm.common import SPACES
from offerlens.llm.routing import FAN, MESSAGE, Items, Net, answer_of, ask, converse, items_of, note, ranges, starts, table

WINDOW = 13
SEED = 6
#: Places that a seed can have in a window, so windows of a fragment at most.
SPAN = WINDOW - SEED + 1
#: Lengths of prefixes in words; beyond the last stands the whole window.
LENGTHS = (1, 2, 4, SEED)
#: Fragments of a prefix up to which it need not be lengthened; more where the corpus has over MOST_PREFIXES times as many.
GROUP = 1 << 18
MOST_PREFIXES = 1 << 19
SHARD_BYTES = 8 << 20
_KEY = np.uint64((1 << 48) - 1)
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: The inverse of _BASE among numbers of 64 bits.
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _word_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: a polynomial by differences of sums, brought to one place and mixed."""
    if not len(begin):
        return np.empty(0, np.uint64)
    upto = np.zeros(len(text) + 1, np.uint64)
    powers = _powers(len(text))
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers, out=upto[1:])
    back = np.full(len(text), _BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mixed((upto[end] - upto[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _strings(words: np.ndarray, many: int) -> np.ndarray:
    """A hash of `many` words from each word on."""
    n = max(0, len(words) - many + 1)
    out = np.zeros(n, np.uint64)
    for k in range(many):
        out = (out + words[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return mixed(out)


def _sliding_min(x: np.ndarray, many: int) -> np.ndarray:
    width, out = 1, x
    while 2 * width <= many:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = many - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Words:
    """The words of a block, with the document of each, and where windows lie that cross no border of documents."""

    def __init__(self, row: dict):
        self.ids, ends, self.text = open_block(row["ids"], row["sizes"], row["body"])
        inner = ~_SPACE[self.text]
        edge = np.ones(len(self.text), bool)
        edge[1:] = ~inner[:-1]
        inside = ends[ends < len(self.text)]
        edge[inside] = True
        self.begin = np.flatnonzero(inner & edge)
        stop = np.ones(len(self.text), bool)
        stop[:-1] = ~inner[1:]
        stop[inside[inside > 0] - 1] = True
        self.end = np.flatnonzero(inner & stop) + 1
        self.doc = np.searchsorted(ends, self.begin, "right")
        self.hashes = _word_hashes(self.text, self.begin, self.end)
        n = len(self.begin) - WINDOW + 1
        self.at = np.flatnonzero(self.doc[WINDOW - 1 :] == self.doc[:n]) if n > 0 else np.empty(0, np.int64)

        self.strings = _strings(self.hashes, SEED)
        #: The seed's hash of every window.
        self.seeds = _sliding_min(self.strings, SPAN)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def fragments(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chosen windows (places in at, ascending): at which of them fragments begin, their windows, and where their seeds' suffixes begin.

        A fragment is a run of windows of one seed, SPAN at most.
        """
        if not len(chosen):
            return (np.empty(0, np.int64),) * 3
        at, seed = self.at[chosen], self.seeds[chosen]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        begin = np.flatnonzero((np.arange(len(at)) - first) % SPAN == 0)
        place, open_ = at[begin].copy(), np.ones(len(begin), bool)
        for k in range(SPAN):
            hit = open_ & (self.strings[at[begin] + k] == seed[begin])
            place[hit] += k
            open_ &= ~hit
        return begin, np.diff(np.append(begin, len(at))), place


# -- 2: prefixes -----------------------------------------------------------------------------------


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    begin = starts(keys[order])
    return (keys[order][begin], np.add.reduceat(n[order], begin)) if len(begin) else (keys, n)


def _counted(slack: float):
    """Of a task's blocks: its fragments by prefix, for each length. A count may lack `slack` for each block, and small ones are let go."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.uint64), np.empty(0, np.int64)) for _ in LENGTHS]
        seen, gone = 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(row)
                seen += 1
                less = int(slack * seen) - gone
                gone += less
                place = words.fragments(np.arange(len(words.at)))[2]
                for k, length in enumerate(LENGTHS):
                    mine = _strings(words.hashes, length)[place] if len(place) else np.empty(0, np.uint64)
                    keys, n = _summed(np.concatenate([held[k][0], mine]), np.concatenate([held[k][1], np.ones(len(mine), np.int64)]))
                    held[k] = keys[n > less], n[n > less]
        for k, (keys, n) in enumerate(held):
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.record_batch([pa.array(np.full(len(keys[part]), k, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part])], names=["length", "prefix", "n"])

    return counted


def long_prefixes(whole: DataFrame, n_blocks: int, n_bytes: int, group: int = GROUP) -> list[np.ndarray]:
    """For each length the prefixes to be lengthened, ascending; 2 * MOST_PREFIXES of a length at most.

    No prefix with more than `limit` fragments is missing: counts lack limit / 2 at most, and those above limit / 2 are taken. There
    is a fragment for two bytes at most, so there are no more than 2 * MOST_PREFIXES of them.
    """
    limit = max(group, n_bytes // 2 // MOST_PREFIXES)
    counts = whole.mapInArrow(_counted(limit / 2 / max(1, n_blocks)), "length int, prefix long, n long").groupBy("length", "prefix").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > limit / 2).select("length", "prefix").toArrow()
    length, prefix = found.column("length").to_numpy(), found.column("prefix").to_numpy().view(np.uint64)
    return [np.sort(prefix[length == k]) for k in range(len(LENGTHS))]


def _is_in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def prefix_of(words: Words, place: np.ndarray, long: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the prefix, whether none is short enough) of the suffixes at those places: of the first length at which it need not be longer."""
    out, open_ = np.zeros(len(place), np.uint64), np.arange(len(place))
    for length, among in zip(LENGTHS, long):
        if not len(open_):
            break
        mine = _strings(words.hashes, length)[place[open_]]
        more = _is_in(mine, among)
        out[open_[~more]] = mine[~more]
        open_ = open_[more]
    alone = np.zeros(len(place), bool)
    alone[open_] = True
    return out, alone


# -- 3: candidates ---------------------------------------------------------------------------------


def _seed_table(words: Words):
    """The windows in order of their seeds' keys, where each distinct key begins, the keys, and whether two documents of the block have it."""
    keys = mixed(words.seeds) & _KEY
    order = np.argsort(keys, kind="stable")
    begin = starts(keys[order])
    if not len(begin):
        return order, begin, keys, np.empty(0, bool)
    owner = words.ids[words.doc[words.at]][order]
    return order, begin, keys[order[begin]], np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)


def _ask_seeds(net: Net):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, keys, several = _seed_table(Words(row))
                yield from table(list(ask(net, row["block"], net.shard_of(keys), Items([keys, several.astype(np.uint8)])))).to_batches()

    return asked


def _answer_seeds(shard: int, items: Items) -> tuple[Items, None]:
    """Of each seed: whether two documents have it, or two blocks, which is taken for two documents."""
    order = np.argsort(items.dense[0], kind="stable")
    begin = starts(items.dense[0][order])
    held = np.diff(np.append(begin, len(order)))
    shared = (held > 1) | (np.maximum.reduceat(items.dense[1][order], begin) > 0)
    back = np.empty(len(order), np.uint8)
    back[order] = np.repeat(shared, held)
    return Items([back]), None


# -- 4: subtrees -----------------------------------------------------------------------------------


def numbers(text: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each word a number that equal words share and no others: by hashes, held against the bytes."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    length, model = end - begin, first[number]
    if (length == length[model]).all() and (text[ranges(begin, length)] == text[ranges(begin[model], length)]).all():
        return number
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(text[a:b].tobytes(), len(known)) for a, b in zip(begin.tolist(), end.tolist())], np.int64)


def _depths(number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words each suffix of a list shares with the one before it, WINDOW at most."""
    out = np.zeros(len(at), np.int64)
    alike = np.arange(1, len(at))
    for k in range(WINDOW):
        alike = alike[number[at[alike] + k] == number[at[alike - 1] + k]]
        out[alike] = k + 1
    return out


def _sorted(number: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of suffixes by their words' numbers, WINDOW words deep."""
    keys = [number[at + k] * (1 << 32) + (number[at + k + 1] if k + 1 < WINDOW else 0) for k in range(0, WINDOW, 2)]
    return np.lexsort(keys[::-1])


def _alike(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of strings of bytes in a list, whether each equals the one before it."""
    out = np.zeros(len(begin), bool)
    near = 1 + np.flatnonzero(length[1:] == length[:-1])
    for a in range(0, len(near), 1 << 16):
        k = near[a : a + (1 << 16)]
        n = length[k]
        same = text[ranges(begin[k], n)] == text[ranges(begin[k - 1], n)]
        out[k] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _collapsed(text: np.ndarray, begin: np.ndarray, length: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new string begins in it): strings of one mark are neighbours, and equal neighbours are one."""
    order = np.argsort(mark, kind="stable")
    same = _alike(text, begin[order], length[order]) & np.concatenate([[False], mark[order][1:] == mark[order][:-1]]) if len(order) else np.empty(0, bool)
    return order, np.flatnonzero(~same)


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The block's words with one space behind each, and where each begins."""
    length = words.end - words.begin + 1
    padded = np.append(words.text, np.uint8(32))
    text = padded[ranges(words.begin, length)]
    ends = np.cumsum(length)
    text[ends - 1] = 32
    return text, np.append(ends - length, len(text))


def _send(net: Net, long) -> object:
    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        """Questions about the distinct fragments of shared seeds, and the block's note of where they are: number, windows and first word of each."""
        out = []
        for row in mine.to_pylist():
            words = Words(row)
            order, begin, keys, _ = _seed_table(words)
            if not len(keys):
                continue
            verdict = answer_of(answers, 1, 0).dense[0]
            each = np.empty(len(order), bool)
            each[order] = np.repeat(verdict > 0, np.diff(np.append(begin, len(order))))
            chosen = np.flatnonzero(each)
            if not len(chosen):
                continue
            at = words.at[chosen]
            start, windows, place = words.fragments(chosen)
            prefix, alone = prefix_of(words, place, long.value)
            # where no prefix is short enough, each window is a fragment of its own and its own prefix
            times = np.where(alone, windows, 1)
            which = np.repeat(np.arange(len(start)), times)
            step = ranges(np.zeros(len(start), np.int64), times)
            first_word, windows = at[start[which] + np.where(alone[which], step, 0)], np.where(alone[which], 1, windows[which])
            whole = _strings(words.hashes, WINDOW)
            prefix = np.where(alone[which], whole[first_word], prefix[which])
            text, head = _spaced(words)
            low, length = head[first_word], head[first_word + windows + WINDOW - 1] - 1 - head[first_word]
            near, edge = _collapsed(text, low, length, mixed(whole[first_word] + windows.astype(np.uint64) * _STEP + whole[first_word + windows - 1]))
            kept = near[edge]
            shard = net.shard_of(mixed(prefix[kept]) & _KEY)
            deal = np.argsort(shard, kind="stable")
            spot = np.empty(len(edge), np.int64)
            spot[deal] = np.arange(len(edge))
            no = np.empty(len(first_word), np.int64)
            no[near] = np.repeat(spot, np.diff(np.append(edge, len(near))))
            out.append(note(row["block"], [x.astype(np.uint64) for x in (no, windows, first_word)]))
            owner = words.ids[words.doc[first_word]][near]
            first, last = (op.reduceat(owner, edge)[deal].view(np.uint64) for op in (np.minimum, np.maximum))
            sent = kept[deal]
            out += ask(net, row["block"], shard[deal], Items([first, last], length[sent], [text[ranges(low[sent], length[sent])]]))
        return table(out)

    return send


def least_below(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fragments (one after the other in text): how many windows each has, and of every window the least of docs below its node.

    Sorted suffixes with the depths that neighbours share are a suffix tree: a node of depth d is a longest run of suffixes that share
    d words with the one before. Those of depth WINDOW are the repeats.
    """
    ends = np.cumsum(sizes)
    space = np.flatnonzero(text == 32)
    begin = np.sort(np.concatenate([ends - sizes, space + 1]))
    end = np.sort(np.concatenate([space, ends]))
    number = numbers(text, begin, end, _word_hashes(text, begin, end))
    owner = np.searchsorted(ends, begin, "right")
    low = np.searchsorted(owner, np.arange(len(sizes)))
    windows = np.diff(np.append(low, len(begin))) - WINDOW + 1
    at = ranges(low, windows)
    order = _sorted(number, at)
    node = np.flatnonzero(_depths(number, at[order]) < WINDOW)
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(np.repeat(docs, windows)[order], node), np.diff(np.append(node, len(order))))
    return windows, least


def _answer_fragments(shard: int, items: Items) -> tuple[Items, None]:
    """Of each fragment's windows: the least document below, where that is before the last document of the block that has it."""
    text, sizes = items.ragged[0], items.times
    first, last = items.dense[0].view(np.int64), items.dense[1].view(np.int64)
    begin = np.cumsum(sizes) - sizes
    near, edge = _collapsed(text, begin, sizes, _word_hashes(text, begin, begin + sizes))
    one = near[edge]
    windows, least = least_below(text[ranges(begin[one], sizes[one])], sizes[one], np.minimum.reduceat(first[near], edge))
    group = np.empty(len(sizes), np.int64)
    group[near] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(near))))
    far = np.cumsum(windows) - windows
    times = windows[group]
    value = least[ranges(far[group], times)]
    return Items([], times, [np.where(value < np.repeat(last, times), value, NO_ID).view(np.uint64)]), None


# -- 5: marks --------------------------------------------------------------------------------------

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(keep_text: bool):
    def finish(mine: pa.Table, answers: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
        for row in mine.to_pylist():
            words = Words(row)
            change = np.zeros(len(words.begin) + 1, np.int64)
            own = [r["items"] for r in answers.filter(answers.column("note")).to_pylist()]
            if own:
                no, windows, first_word = (x.astype(np.int64) for x in items_of(own, 3, 0).dense)
                told = answer_of(answers.filter(pc.invert(answers.column("note"))), 0, 1)
                least = told.ragged[0].view(np.int64)[ranges((np.cumsum(told.times) - told.times)[no], windows)]
                at = ranges(first_word, windows)
                hit = at[least < words.ids[words.doc[at]]]
                change[hit] += 1  # a place holds one window
                change[hit + WINDOW] -= 1
            gone = np.cumsum(change[:-1]) > 0
            text, head = _spaced(words)
            held = np.diff(head) * ~gone
            kept = text[np.repeat(~gone, np.diff(head))]
            far = np.concatenate([[0], np.cumsum(held)])
            low = np.searchsorted(words.doc, np.arange(len(words.ids) + 1))
            removed = np.concatenate([[0], np.cumsum(gone)])
            for k, (key, named) in enumerate(zip(words.ids.tolist(), named_rows(row))):
                a, b = low[k], low[k + 1]
                rest = kept[far[a] : far[b]].tobytes()[:-1]
                cols["doc_id"].append(key if named else None)
                cols["n_words"].append(int(b - a))
                cols["n_removed"].append(int(removed[b] - removed[a]))
                cols["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    cols["text"].append(rest.decode("utf-8", "ignore"))
        types = [*[pa.int64()] * 3, pa.string(), pa.string()]
        return pa.table({n: pa.array(c, t) for (n, c), t in zip(cols.items(), types) if keep_text or n != "text"})

    return finish


def remove_passages(docs: DataFrame, keep_text: bool = False, group: int = GROUP, fan: int = FAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs, and the words that are left, spaced singly, if asked for."""
    whole = blocks(docs)
    sums = whole.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).head()
    net = Net(max(1, -(-(sums.b or 0) // shard_bytes)), sums.n, fan)
    long = docs.sparkSession.sparkContext.broadcast(long_prefixes(whole, sums.n, sums.b or 0, group))
    verdicts = converse(whole.mapInArrow(_ask_seeds(net), MESSAGE), _answer_seeds, net, (2, 0), (1, 0))
    sent = whole.groupBy("block").cogroup(verdicts.groupBy("to")).applyInArrow(_send(net, long), MESSAGE)
    back = converse(sent, _answer_fragments, net, (2, 1), (0, 1))
    schema = RESULT + (", text string" if keep_text else "")
    return whole.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_finish(keep_text), schema)
