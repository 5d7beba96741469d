"""Token counts by a compiled finite-state transducer over characters.

Byte-pair encoding is turned into a deterministic transducer. The last token of the encoding of a
prefix is unique, and a token sequence is an encoding exactly if each neighbouring pair encodes to
itself; so the last token after one more character is the one suffix token that pairs with the
last token before it. A state holds what later characters can depend on: the longest suffix that
still begins some token, and for each position in it the last token and the number of tokens since.
A transition emits the change of the token count, which sums to the count of the whole text.
States are numbered, compiled when first reached, and kept; their number is finite.

Chunks. Every text is counted by the maps of its chunks: WITHIN characters each, composed in the task that has the text; a text over CHUNK
characters is cut anywhere into rows of its own, and every task takes some of them.
A chunk's map sends each state in which it may be entered to the state in which it is left and the tokens between. Which
states these are is told by the LOOK characters before it: a space or a line feed among them leaves one (no piece holds
the space mark after another character), else every place of one piece's length at which the last token may have begun
gives one, and these soon fall together. Maps compose associatively, so those of a text are
composed by groups of ARITY, level by level: a parallel prefix scan in the logarithm of the chunks. If a map
lacks the state that arrives, the composition says so, the chunk's map gets that state too, and the scan is repeated:
the count is exact in any case, and no task holds more than a chunk of the text or ARITY maps.
Runs between sync places recur, so their counts are remembered, up to MEMO.

Defined cases: a null text is empty with 0 bytes and tokens; whole texts of any length are counted;
repeated rows are counted one by one; extra columns are ignored, whatever their names; an empty table gives no rows; bytes that aren't UTF-8 count as
U+FFFD, as the text itself would show them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import cut, id_and_bytes

LIMIT = 4096
CHUNK = 1 << 20
WITHIN = 1 << 14
LOOK = 256
ARITY = 64
MEMO = 500_000
STATES = 400_000
MARK = "▁"
MODEL = "piece_bpe_32k.model"


class State(NamedTuple):
    """suffix: the longest suffix of the text that begins a longer token; last[j], since[j]: the last token j characters back, the tokens since then (blank where no token can start)."""

    suffix: str
    last: tuple[str | None, ...]
    since: tuple[int, ...]


START = State("", (None,), (0,))


class Exit(NamedTuple):
    """Where an entry state leads: the state behind the chunk and the tokens, or the chunk (missing) whose map lacks the state that arrives there."""

    state: State
    count: int
    missing: int = -1


ChunkMap = dict[State, Exit]


def compose(first: ChunkMap, second: ChunkMap, number: int) -> ChunkMap:
    """first, then second, whose first chunk has that number."""
    out = {}
    for entry, x in first.items():
        if x.missing < 0 and (y := second.get(x.state)) is not None:
            x = Exit(y.state, x.count + y.count, y.missing)
        elif x.missing < 0:
            x = x._replace(missing=number)
        out[entry] = x
    return out


def compose_all(maps: list[tuple[int, ChunkMap]]) -> ChunkMap:
    """The composition of maps in order, by halves."""
    if len(maps) == 1:
        return maps[0][1]
    half = len(maps) // 2
    return compose(compose_all(maps[:half]), compose_all(maps[half:]), maps[half][0])


class Transducer:
    """scores: piece -> score, higher merges first; unknown characters count their UTF-8 bytes (byte fallback)."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        self.scores, self.byte_fallback = scores, byte_fallback
        self.alphabet = {c for c in scores if len(c) == 1}
        self.longest = max(map(len, scores), default=1)
        self.sync_at_mark = not any(MARK in p.lstrip(MARK) for p in scores)
        self._encoded: dict[str, tuple[str, ...]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.tokens = {p for p in scores if len(p) == 1 or self.encode(p) == (p,)}
        self.begins = {p[:k] for p in self.tokens for k in range(1, len(p))}
        self._memo: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        """States are numbered; number 0 is the start. Each has a table of the characters met so far."""
        self._states, self._numbers, self._next = [START], {START: 0}, [{}]

    def encode(self, text: str) -> tuple[str, ...]:
        """Merge by merge, as the definition has it; used on short strings to compile."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(parts)

    def _pair(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (ok := self._pairs.get((a, b))) is None:
            if len(self._pairs) > STATES:
                self._pairs.clear()
            ok = self._pairs[a, b] = self.encode(a + b) == (a, b)
        return ok

    def _compile(self, number: int, char: str) -> tuple[int, int]:
        """The number of the next state and the tokens that char adds (it may take some away)."""
        state = self._states[number]
        if char not in self.alphabet:
            after, added = START, len(char.encode("utf-8", "replace")) if self.byte_fallback else 1
        else:
            text = state.suffix + char
            for k in range(1, len(text) + 1):
                token = text[-k:]
                if token in self.tokens and self._pair(state.last[k - 1], token):
                    break
            else:
                raise AssertionError(f"no token ends {text!r}")
            added = 1 - state.since[k - 1]
            cut = next((i for i in range(max(0, len(text) - self.longest + 1), len(text)) if text[i:] in self.begins), len(text))
            keep = len(text) - cut
            # a token can only start where what follows begins one; what stands elsewhere is forgotten
            open_ = [j == 0 or text[-j:] in self.begins for j in range(keep + 1)]
            last = tuple(x if o else "" for x, o in zip((token, *state.last), open_))
            since = tuple(x if o else 0 for x, o in zip((0, *(x + added for x in state.since)), open_))
            after = State(text[cut:], last, since)
        to = self._number(after)
        self._next[number][char] = to, added
        return to, added

    def run(self, state: int, text: str) -> tuple[int, int]:
        total, tables = 0, self._next
        for char in text:
            state, n = tables[state].get(char) or self._compile(state, char)
            total += n
        return state, total

    def _runs(self, text: str) -> list[str]:
        return (_MARK_RUNS if self.sync_at_mark else _LINE_RUNS).findall(text)

    def _counted(self, run: str) -> int:
        if (n := self._memo.get(run)) is None:
            n = self.run(0, run)[1]
            if len(self._memo) < MEMO and len(run) < 64:
                self._memo[run] = n
        return n

    def entries(self, before: str, whole: bool) -> set[State]:
        """The states in which text goes on behind `before`; whole: nothing comes before that."""
        runs = self._runs(before)
        if whole or len(runs) > 1:
            return {self._states[self.run(0, runs[-1] if runs else "")[0]]}
        return {self._states[self.run(0, before[k:])[0]] for k in range(min(len(before), self.longest + 1))}

    def chunk_map(self, text: str, entries: set[State]) -> ChunkMap:
        """What text does to the entry states. From the first sync place on, that is the same for all."""
        runs = self._runs(text)
        head = "" if text and _starts_run(text, self.sync_at_mark) and text[0] != MARK else runs.pop(0) if runs else ""
        synced = bool(runs)
        count = sum(map(self._counted, runs[:-1]))
        state, n = self.run(0, runs[-1]) if synced else (0, 0)
        out = {}
        for entry in entries:
            inner, m = self.run(self._number(entry), head)
            out[entry] = Exit(self._states[state if synced else inner], m + count + n)
        return out

    def _number(self, state: State) -> int:
        to = self._numbers.get(state)
        if to is None:
            to = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._next.append({})
        return to

    def count_by_maps(self, text: str, size: int = WITHIN, look: int = LOOK) -> int:
        """Tokens of text, which has the space marks already: the maps of its chunks, composed."""
        if len(self._states) > STATES:
            self._clear()
        if not text:
            return 0
        lacking: dict[int, set[State]] = {}
        while True:
            maps = []
            for k, at in enumerate(range(0, len(text), size)):
                entries = self.entries(text[max(0, at - look) : at], at <= look) | lacking.get(k, set())
                maps.append((k, self.chunk_map(text[at : at + size], entries)))
            (end,) = compose_all(maps).values()
            if end.missing < 0:
                return end.count
            lacking.setdefault(end.missing, set()).add(end.state)

    def count(self, text: str) -> int:
        """The same in one go, without cutting text."""
        if len(self._states) > STATES:
            self._clear()
        memo = self._memo
        return sum([n if (n := memo.get(r)) is not None else self._counted(r) for r in self._runs(text)])


_MARK_RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|^[^{MARK}\n]+")
_LINE_RUNS = re.compile("\n[^\n]*|^[^\n]+")


def _starts_run(text: str, marks: bool) -> bool:
    return text[0] == "\n" or marks and text[0] == MARK


@lru_cache(2)
def compiled(path: str) -> tuple[Transducer, bool]:
    """The transducer of a sentencepiece BPE model, and whether it puts a space before a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if "\n" in scores:
        raise ValueError("a model whose vocabulary holds the line feed has other sync places")
    return Transducer(scores, any(sp.is_byte(i) for i in ids)), sp.encode("", out_type=str) == [] and sp.normalize("a") == MARK + "a"


def marked(text: str, path: str) -> str:
    """text as the transducer reads it."""
    if not text:
        return ""
    text = text.replace(" ", MARK)
    return MARK + text if compiled(path)[1] else text


def count_text(text: str, path: str) -> int:
    return compiled(path)[0].count_by_maps(marked(text, path))


# -- chunks as rows --------------------------------------------------------------------------------


def _write(state: State) -> str:
    return json.dumps(state)


def _read(text: str) -> State:
    suffix, last, since = json.loads(text)
    return State(suffix, tuple(last), tuple(since))


CHUNKS = "doc_id long, n_bytes long, n_tokens long, text_no long, chunk long, before string, part string"
MAPS = "text_no long, chunk long, entries array<string>, exits array<string>, counts array<long>, missing array<long>"


def _maps_table(rows: list[tuple[int, int, ChunkMap]]) -> pa.Table:
    cols = list(zip(*((no, chunk, [_write(e) for e in m], [_write(x.state) for x in m.values()], [x.count for x in m.values()], [x.missing for x in m.values()]) for no, chunk, m in rows))) or [()] * 6
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in MAPS.split(", ")])


def _map_of(row: dict) -> ChunkMap:
    return {_read(e): Exit(_read(x), n, m) for e, x, n, m in zip(row["entries"], row["exits"], row["counts"], row["missing"])}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, look: int = LOOK, arity: int = ARITY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with its count for each text of at most a chunk; a row for each chunk of the others."""
        no = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = body.as_buffer()
                text = marked(str(raw, "utf-8", "replace"), path)
                if len(text) <= chunk:
                    rows.append((key, len(raw), compiled(path)[0].count_by_maps(text), None, None, None, None))
                    continue
                for k, at in enumerate(range(0, len(text), chunk)):
                    rows.append((key, len(raw), None, no, k, text[max(0, at - look) : at], text[at : at + chunk]))
                no += 1
            cols = list(zip(*rows)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.string() if k > 4 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    first = cut(id_and_bytes(docs).mapInArrow(counted, CHUNKS))
    rows = first.where("text_no IS NULL").select("doc_id", "n_bytes", "n_tokens")
    chunks = first.where("text_no IS NOT NULL")
    top = chunks.agg(F.max("chunk")).head()[0]
    if top is not None:
        counts = _scan(chunks.select("text_no", "chunk", "before", "part"), top, path, look, arity)
        rows = rows.union(chunks.where("chunk = 0").join(counts, "text_no").select("doc_id", "n_bytes", "count"))
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))


def _scan(chunks: DataFrame, top: int, path: str, look: int, arity: int) -> DataFrame:
    """(text_no, count) of the texts whose chunks are given."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = compiled(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                entries = machine.entries(r["before"], r["chunk"] == 0 or len(r["before"]) < look) | set(map(_read, r["more"]))
                rows.append((r["text_no"], r["chunk"], machine.chunk_map(r["part"], entries)))
            yield from _maps_table(rows).to_batches()

    def composed(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        return _maps_table([(rows[0]["text_no"], rows[0]["chunk"], compose_all([(r["chunk"], _map_of(r)) for r in rows]))])

    spark = chunks.sparkSession
    told = spark.createDataFrame([], "text_no long, chunk long, state string")
    while True:
        more = told.groupBy("text_no", "chunk").agg(F.collect_set("state").alias("more"))
        asked = chunks.join(more, ["text_no", "chunk"], "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
        maps, span = asked.repartition("text_no", "chunk").mapInArrow(mapped, MAPS), 1
        while span <= top:
            span *= arity
            maps = maps.groupBy("text_no", F.expr(f"chunk div {span}")).applyInArrow(composed, MAPS)
        # every text is entered in one state
        ends = cut(maps.select("text_no", F.col("exits")[0].alias("state"), F.col("counts")[0].alias("count"), F.col("missing")[0].alias("missing")))
        lacking = ends.where("missing >= 0").select("text_no", F.col("missing").alias("chunk"), "state")
        if lacking.isEmpty():
            return ends.select("text_no", "count")
        told = cut(told.union(lacking))
