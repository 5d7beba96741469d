"""Removal of long repeats across documents by a run-length suffix index.

A byte goes if a 50-byte string covers it that also starts in a document with a smaller doc_id.

1. Anchors. In every 50-byte window the 20-byte seed of the least hash is its anchor; windows that
   are equal have equal anchors, at the same place. Blocks of documents ask shards which of their
   seeds occur in another document as well (a question per block and distinct seed).
2. Fragments. Around each such anchor, the text that its windows span (50 to 80 bytes) is a
   fragment. Blocks send each distinct fragment once, with the least doc_id that has it, to the
   shard of its seed. A seed with more than HOT occurrences sends its windows one by one, each to
   the shard of its own hash, so that no seed, however common, meets in one task.
3. Index. A shard collapses equal fragments; the rest are its text. Of that, the run-compressed
   Burrows-Wheeler transform is built, with the suffix positions sampled at both ends of every run; the suffix array
   is dropped. All fragments are then walked backwards at once, from their ends, by LF steps over the runs, which
   gives the row of every position. The matching statistics of a position with the row above it drop by at most one
   from one position to the next and start anew only at a run's head, where the samples of this run's head and of the last
   run's tail are compared: so they are computed there and streamed along the text. Rows between which they reach 50
   start with the same window, a long match; the least doc_id among those rows is the window's first document.
4. Marks. The answer, runs of windows with their first document, goes back to the blocks, which mark
   every window whose first document is smaller than its own, and hash what is left.

The comparison is of the bytes themselves; hashes only choose what meets where. Blocks and shards talk over hops of
bounded fan-out (routing): messages are at most FAN for each block and hop, so their number grows with the input, not with blocks times shards.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; rows that share a doc_id are
no copies of each other; a null doc_id counts as larger than any; matches never cross documents; an
empty table gives no rows; extra columns are ignored; texts of any length are handled whole. With keep_text,
the remaining bytes are decoded; those of a character that was cut through go (kept_sha256 counts them).
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
from offerlens.llm.routing import FAN, MESSAGE, Items, Net, answer_of, ask, converse, items_of, note, ranges, starts, table

LENGTH = 50
SEED = 20
SPAN = LENGTH - SEED + 1  # seeds in a window
WIDEST = LENGTH + SPAN - 1
HOT = 20_000
SHARD_BYTES = 8 << 20
_KEY = np.uint64((1 << 48) - 1)


def _sliding(x: np.ndarray, op) -> np.ndarray:
    """op over every run of SPAN values."""
    width, out = 1, x
    while 2 * width <= SPAN:
        out = op(out[:-width], out[width:])
        width *= 2
    rest = SPAN - width
    return op(out[:-rest], out[rest:]) if rest else out


def _seed_hashes(text: np.ndarray) -> np.ndarray:
    n = len(text) - SEED + 1
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text),), "<u8", buffer=padded.data, strides=(1,))
    fours = np.ndarray((len(text),), "<u4", buffer=padded.data, strides=(1,))
    h = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eights[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += fours[16 : 16 + n]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h | np.uint64(1)  # zero marks windows that cross documents


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, least): the seeds that are least in a window, and each window's least hash (0 if it crosses documents)."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = _seed_hashes(text)
    least = _sliding(h, np.minimum)
    crossing = (ends[:, None] - np.arange(1, LENGTH)).ravel()
    least[crossing[(crossing >= 0) & (crossing < len(least))]] = 0
    pad = np.zeros(SPAN - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at], least


# -- 1: which seeds occur in another document ------------------------------------------------------


def _seed_table(text: np.ndarray, ends: np.ndarray, ids: np.ndarray):
    """Anchors of a block, and per distinct key: ascending keys, occurrences, whether two documents of the block hold it."""
    at, h, least = anchors(text, ends)
    keys = mixed(h) & _KEY
    order = np.argsort(keys, kind="stable")
    begin = starts(keys[order])
    owner = ids[np.searchsorted(ends, at, "right")][order] if len(at) else np.empty(0, np.int64)
    if not len(begin):
        return at, h, least, order, begin, keys[:0], np.empty(0, np.int64), np.empty(0, bool)
    several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
    return at, h, least, order, begin, keys[order[begin]], np.diff(np.append(begin, len(order))), several


def _ask_seeds(net: Net):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ends, text = open_block(row["ids"], row["sizes"], row["body"])
                *_, keys, n, several = _seed_table(text, ends, ids)
                coded = (2 * np.minimum(n, 1 << 40) + several).astype(np.uint64)
                yield from table(list(ask(net, row["block"], net.shard_of(keys), Items([keys, coded])))).to_batches()

    return asked


def _answer_seeds(hot: int):
    def answer(shard: int, items: Items) -> tuple[Items, None]:
        """Of each seed: 0 if one document alone has it, 2 if it is hot, else 1."""
        every, coded = items.dense[0], items.dense[1].astype(np.int64)
        order = np.argsort(every, kind="stable")
        begin = starts(every[order])
        held, n = np.diff(np.append(begin, len(every))), coded[order]
        shared = (held > 1) | (np.maximum.reduceat(n & 1, begin) > 0)
        verdict = np.where(shared, np.where(np.add.reduceat(n >> 1, begin) > hot, 2, 1), 0).astype(np.uint8)
        back = np.empty(len(every), np.uint8)
        back[order] = np.repeat(verdict, held)
        return Items([back]), None

    return answer


# -- 2: fragments ----------------------------------------------------------------------------------


def _fragments(text, ends, at, h, least, hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, hot) of the text that each anchor's windows span; hot anchors give one fragment per window."""
    offsets = np.arange(-(SPAN - 1), 1)
    begin, count, heat = [], [], []
    for s in range(0, len(at), 1 << 17):
        p = at[s : s + (1 << 17)]
        places = p[:, None] + offsets
        inside = (places >= 0) & (places < len(least))
        mine = inside & (least[np.clip(places, 0, len(least) - 1)] == h[s : s + (1 << 17), None])
        first = mine.argmax(axis=1)
        begin.append(p + offsets[0] + first)
        count.append(mine.sum(axis=1))
        heat.append(hot[s : s + (1 << 17)])
    if not begin:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    begin, count, heat = np.concatenate(begin), np.concatenate(count), np.concatenate(heat)
    times = np.where(heat, count, 1)
    which = np.repeat(np.arange(len(begin)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return begin[which] + np.where(heat[which], step, 0), np.where(heat[which], 1, count[which]), which


def _texts(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of WIDEST bytes and a length byte, zeros behind the fragment."""
    padded = np.concatenate([text, np.zeros(WIDEST, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[start]
    rows = np.where(np.arange(WIDEST) < length[:, None], rows, 0).astype(np.uint8)
    return np.concatenate([rows, length[:, None].astype(np.uint8)], axis=1)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for col in wide.view("<u8").T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + col)
    return h


def _equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, order, where a new row begins in that order): equal rows are neighbours."""
    mark = _row_hash(rows)
    order = np.argsort(mark, kind="stable")
    ordered = rows[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    if (new[1:] & (mark[order][1:] == mark[order][:-1])).any():  # two rows of one hash: order by the bytes
        void = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
        order = np.argsort(void, kind="stable")
        new = np.concatenate([[True], void[order][1:] != void[order][:-1]])
    return mark, order, np.flatnonzero(new)


def _seed_of(rows: np.ndarray) -> np.ndarray:
    """The least seed hash of each row's first window, which all of its windows share."""
    flat = _seed_hashes(np.ascontiguousarray(rows[:, :LENGTH]).ravel())
    padded = np.concatenate([flat, np.zeros(SEED - 1, np.uint64)]).reshape(len(rows), LENGTH)
    return padded[:, :SPAN].min(axis=1)


def _send_fragments(net: Net):
    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        """Questions about distinct fragments, and the block's note of where they are: number, windows, start of each place."""
        out = []
        for row in mine.to_pylist():
            ids, ends, text = open_block(row["ids"], row["sizes"], row["body"])
            at, h, least, order, begin, keys, _, _ = _seed_table(text, ends, ids)
            verdict = answer_of(answers, 1, 0).dense[0] if len(keys) else np.empty(0, np.uint8)
            each = np.empty(len(at), np.uint8)
            each[order] = np.repeat(verdict, np.diff(np.append(begin, len(order))))
            chosen = np.flatnonzero(each)
            if not len(chosen):
                continue
            start, windows, which = _fragments(text, ends, at[chosen], h[chosen], least, each[chosen] == 2)
            rows = _texts(text, start, windows + LENGTH - 1)
            mark, near, edge = _equal_rows(rows)
            kept = near[edge]
            seed = mixed(h[chosen][which[kept]]) & _KEY
            shard = net.shard_of(np.where((each[chosen] == 2)[which[kept]], mark[kept] & _KEY, seed))
            deal = np.argsort(shard, kind="stable")
            place = np.empty(len(edge), np.int64)
            place[deal] = np.arange(len(edge))
            no = np.empty(len(start), np.int64)
            no[near] = np.repeat(place, np.diff(np.append(edge, len(near))))
            spot = np.argsort(start, kind="stable")
            out.append(note(row["block"], [x[spot].astype(np.uint64) for x in (no, windows, start)]))
            owner = ids[np.searchsorted(ends, start, "right")][near]
            first, last = (op.reduceat(owner, edge)[deal].view(np.uint64) for op in (np.minimum, np.maximum))
            r = rows[kept[deal]]
            body = r[:, :WIDEST][np.arange(WIDEST) < r[:, WIDEST:]]
            out += ask(net, row["block"], shard[deal], Items([first, last], r[:, WIDEST], [body]))
        return table(out)

    return send


# -- 3: the index ----------------------------------------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of fragments, with the suffix positions at both ends of every run.

    body: the fragments one after the other; sizes: their lengths. Every fragment ends in a mark of
    its own that is less than any byte; the marks are the first rows, in the order of the fragments.
    run_at: the rows at which runs begin, also as bits with counts for every 64 rows; run_symbol: their symbols;
    run_shift: how far LF takes their rows.
    """

    def __init__(self, body: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        n = self.n = len(body) + len(sizes)  # a mark after every fragment
        self.ends = np.cumsum(sizes + 1) - 1
        symbols = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.ends] = False
        symbols[inner] = body.astype(np.int64) + 1
        self.left = (np.repeat(self.ends, sizes + 1) - np.arange(n)).astype(np.int32)  # symbols before the mark
        self.keys = self._sevens(symbols)
        order = self._sorted()
        before = np.empty(n, np.int16)
        before[1:] = symbols[:-1]
        before[0] = 0
        bwt = before[order]
        # a fragment's first symbol follows a mark; marks differ, so each is a run
        heads = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])
        self.run_at = np.flatnonzero(heads)
        self.run_symbol = bwt[self.run_at]
        self.head_sample = order[self.run_at]
        self.tail_sample = order[np.append(self.run_at[1:], n) - 1]
        length = np.diff(np.append(self.run_at, n))
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        run_to = np.empty(len(length), np.int64)
        run_to[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        self.run_shift = run_to - self.run_at
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[self.run_at] = 1
        self.head_bits = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.head_bits).astype(np.int64)
        self.runs_before = np.cumsum(counts) - counts

    def run_of(self, rows: np.ndarray) -> np.ndarray:
        """The run of each row: heads up to it, by the count before its 64 rows and those among them."""
        word = rows >> 6
        upto = self.head_bits[word] << (np.uint64(63) - (rows & 63).astype(np.uint64))
        return self.runs_before[word] + np.bitwise_count(upto) - 1

    def lf(self, rows: np.ndarray) -> np.ndarray:
        """Of rows, the rows of the suffixes one symbol longer; defined where that symbol is no mark."""
        return rows + self.run_shift[self.run_of(rows)]

    def rows(self) -> np.ndarray:
        """The row of every text position, by LF steps from all fragments' marks at once."""
        out = np.empty(self.n, np.int64)
        lanes = np.argsort(-self.sizes, kind="stable")
        at, row = self.ends[lanes], lanes.copy()
        many = np.searchsorted(-self.sizes[lanes], -np.arange(1, int(self.sizes.max(initial=0)) + 1), "right")  # fragments of t symbols or more
        out[at] = row
        for t, m in enumerate(many.tolist(), 1):
            row = self.lf(row[:m])
            out[at[:m] - t] = row
        return out

    def _sevens(self, symbols: np.ndarray) -> np.ndarray:
        """Seven symbols of nine bits from every position on; what lies behind the fragment's mark is zero."""
        n = len(symbols)
        out = np.zeros(n, np.int64)
        for j in range(7):
            part = symbols[j:] << np.int64(9 * (6 - j))
            out[: n - j] |= np.where(self.left[: n - j] > j, part, 0)
        return out

    def _sorted(self) -> np.ndarray:
        """The suffix array by doubling; what is told apart isn't sorted again. A rank is the row at which a suffix' equals begin."""
        order = np.argsort(self.keys)
        n, width = len(order), 7
        ordered = self.keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        ranks = np.empty(n, np.int64)
        rows, first = np.arange(n), np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ranks[order] = first
        while True:
            # rows that have an equal beside them
            alike = ~new
            alike[:-1] |= ~new[1:]
            rows, first = rows[alike], first[alike]
            if not len(rows):
                return order
            suffix = order[rows]
            # equals that end within the width keep the order of the text, as marks of their own would have it
            open_ = self.left[suffix] >= width
            pair = first * (n + 1) + np.where(open_, ranks[np.where(open_, suffix + width, 0)], suffix)
            within = np.argsort(pair)
            order[rows] = suffix = suffix[within]
            pair = pair[within]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            first = np.maximum.accumulate(np.where(new, rows, 0))
            ranks[suffix] = first
            width *= 2

    def matching(self) -> np.ndarray:
        """Of every text position, how many symbols it shares with the row above it, streamed from the run ends."""
        reach = np.zeros(self.n, np.int64)
        a, b = self.head_sample[1:], self.tail_sample[:-1]
        same, alive, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        bound = np.minimum(self.left[a], self.left[b])
        while len(alive):  # seven symbols at a time
            x, y = a[alive] + 7 * k, b[alive] + 7 * k
            inside = 7 * k < bound[alive]
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            differ = self.keys[x] ^ self.keys[y]
            equal = self._first_difference(differ)
            same[alive] = np.where(inside, np.minimum(7 * k + equal, bound[alive]), same[alive])
            alive = alive[inside & (equal == 7)]
            k += 1
        reach[a] = a + same
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)

    @staticmethod
    def _first_difference(differ: np.ndarray) -> np.ndarray:
        out = np.full(len(differ), 7, np.int64)
        for j in range(6, -1, -1):
            out[(differ >> np.int64(9 * (6 - j))) & 511 != 0] = j
        return out

    def first_of_windows(self, firsts: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Of every text position with `length` symbols or more: the least of firsts among the fragments in which that string occurs."""
        rows = self.rows()
        shared = np.zeros(self.n, np.int32)
        shared[rows] = self.matching()
        # rows of positions with less than that many symbols share less with both neighbours
        new = shared < length
        new[0] = True
        at = np.flatnonzero(self.left >= length)
        by_row = np.full(self.n, NO_ID, np.int64)
        by_row[rows[at]] = np.repeat(firsts, self.sizes + 1)[at]
        least = np.minimum.reduceat(by_row, np.flatnonzero(new))
        out = np.full(self.n, NO_ID, np.int64)
        out[at] = least[np.cumsum(new)[rows[at]] - 1]
        return out


def _answer_fragments(shard: int, items: Items) -> tuple[Items, None]:
    """Of each fragment: runs of its windows (from and to in one number) with their first document, where that is before the last that has it."""
    sizes, lasts = items.times, items.dense[1].view(np.int64)
    texts = _texts(items.ragged[0], np.cumsum(sizes) - sizes, sizes)
    _, order, begin = _equal_rows(texts)
    group = np.empty(len(sizes), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    least = np.minimum.reduceat(items.dense[0].view(np.int64)[order], begin)
    one = texts[order[begin]]
    size = one[:, WIDEST].astype(np.int64)
    # a fragment that is the only one of its seed here shares its windows with no other
    seed = _seed_of(one)
    by_seed = np.argsort(seed, kind="stable")
    edge = starts(seed[by_seed])
    several = np.empty(len(seed), bool)
    several[by_seed] = np.repeat(np.diff(np.append(edge, len(seed))) > 1, np.diff(np.append(edge, len(seed))))
    first = np.repeat(least, size + 1)
    if several.any():
        some, long = one[several], size[several]
        index = RunIndex(some[:, :WIDEST][np.arange(WIDEST) < long[:, None]], long)
        first[np.repeat(several, size + 1)] = index.first_of_windows(least[several])
    # per distinct fragment: runs of windows with one first document
    head = np.cumsum(size + 1) - (size + 1)
    windows = size - LENGTH + 1
    which = np.repeat(np.arange(len(size)), windows)
    step = ranges(np.zeros(len(size), np.int64), windows)
    value = first[head[which] + step]
    edge = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (value[1:] != value[:-1])]))
    run_of, run_from, run_first = which[edge], step[edge], value[edge]
    run_to = np.append(edge[1:], len(which)) - edge + run_from
    first_run = np.searchsorted(run_of, np.arange(len(size)))
    times = np.diff(np.append(first_run, len(run_of)))[group]
    of = np.repeat(np.arange(len(group)), times)
    r = ranges(first_run[group], times)
    useful = run_first[r] < lasts[of]
    of, r = of[useful], r[useful]
    spans = (run_from[r] * 256 + run_to[r]).astype(np.uint64)
    return Items([], np.bincount(of, minlength=len(group)), [spans, run_first[r].view(np.uint64)]), None


# -- 4: marks --------------------------------------------------------------------------------------


def _removed(n: int, ends: np.ndarray, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    told = answers.to_pylist()
    own = [r["items"] for r in told if r["note"]]
    if own:
        no, _, start = (x.astype(np.int64) for x in items_of(own, 3, 0).dense)
        runs = answer_of(answers.filter(pc.invert(answers.column("note"))), 0, 2)
        span, first = runs.ragged[0].astype(np.int64), runs.ragged[1].view(np.int64)
        times = runs.times[no]
        of = np.repeat(np.arange(len(no)), times)
        r = ranges((np.cumsum(runs.times) - runs.times)[no], times)
        mine = ids[np.searchsorted(ends, start[of], "right")]
        hit = first[r] < mine
        of, r = of[hit], r[hit]
        np.add.at(change, start[of] + span[r] // 256, 1)
        np.add.at(change, start[of] + span[r] % 256 + LENGTH - 1, -1)
    return np.cumsum(change[:n]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(keep_text: bool):
    def finish(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out, kept_texts = [], []
        for row in mine.to_pylist():
            ids, ends, text = open_block(row["ids"], row["sizes"], row["body"])
            gone = _removed(len(text), ends, ids, answers)
            start = 0
            for key, named, end in zip(ids.tolist(), named_rows(row), ends.tolist()):
                g = gone[start:end]
                kept = text[start:end][~g].tobytes()
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
                out.append((key if named else None, end - start, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
                if keep_text:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
                start = end
        cols = list(zip(*out)) or [()] * 5
        types = [*[pa.int64()] * 4, pa.string()]
        data = {n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, types)}
        return pa.table(data | ({"text": pa.array(kept_texts, pa.string())} if keep_text else {}))

    return finish


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot: int = HOT, fan: int = FAN, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs, and the remaining text if asked for."""
    whole = blocks(docs)
    sums = whole.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).head()
    net = Net(max(1, -(-(sums.b or 0) // shard_bytes)), sums.n, fan)
    verdicts = converse(whole.mapInArrow(_ask_seeds(net), MESSAGE), _answer_seeds(hot), net, (2, 0), (1, 0))
    sent = whole.groupBy("block").cogroup(verdicts.groupBy("to")).applyInArrow(_send_fragments(net), MESSAGE)
    back = converse(sent, _answer_fragments, net, (2, 1), (0, 2))
    schema = RESULT + (", text string" if keep_text else "")
    return whole.groupBy("block").cogroup(back.groupBy("to")).applyInArrow(_finish(keep_text), schema)
