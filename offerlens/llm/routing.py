"""Questions from blocks to shards and answers back, over hops of bounded fan-out.

A block has items, each of which belongs to a shard, and wants an answer for each. Both blocks and
shards are many in a large corpus, so a message for each pair of them would be their product. Here a sender
sends FAN messages at most: shards are numbers of `levels` digits to a base of FAN at most. At a hop, a message goes to all
shards of one more leading digit; it is received together with those of as many senders as the base, whose items are put
together, dealt out by the next digit and sent on. So messages number FAN at most for each block and hop, and hops are the
logarithm of the shards: one for up to FAN shards, two for up to FAN squared, whatever the blocks. The base is the least
that these digits allow (not FAN itself, of which 300 shards would use two first digits): so a receiver holds about as much as
a block sends, whatever the shards. Answers go back over
the same hops; a receiver's note to itself, which travels with what it sends on, says whose they are.

What was received is kept in the checkpoint folder until it has been sent on. The last hop is gone in WAVES, to some of the shards at a time,
and the answers of each are written before the next: so what is received, and the same dealt to shards, don't lie on disk as a whole at once.

Items are columns of integers; besides, each item may have any number of rows of further columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.byte_blocks import cut_by, cut_settled, expand, mixed, pack_ints, squeeze, unpack_ints
from offerlens.llm.common import release, shuffle_partitions

FAN = 256
#: Partitions that shards are dealt into at most; a task takes its shards one by one.
MOST_PARTITIONS = 16_384
MESSAGE = "to long, frm long, stats array<long>, items array<binary>"
_GROUP = 31
#: In how many parts the last of several hops is gone.
WAVES = 2
#: Where receivers' notes to themselves begin, downwards (blocks' notes begin at -1), and bits of a receiver.
_HELD, _RECEIVER = -(1 << 62), 57


def starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _pack(values: np.ndarray) -> bytes:
    return b"\0" + squeeze(values.tobytes()) if values.dtype == np.uint8 else pack_ints(values)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(expand(data[1:]), np.uint8) if data[0] == 0 else unpack_ints(data)


class Items:
    """Columns of integers (unsigned 64 or 8 bits); item i has times[i] rows of the ragged columns."""

    def __init__(self, dense: Sequence[np.ndarray], times: np.ndarray | None = None, ragged: Sequence[np.ndarray] = ()):
        self.dense, self.times, self.ragged = list(dense), None if times is None else np.asarray(times, np.int64), list(ragged)

    def __len__(self) -> int:
        return len(self.dense[0] if self.dense else self.times)

    def take(self, order: np.ndarray) -> Items:
        if self.times is None:
            return Items([x[order] for x in self.dense])
        at = ranges((np.cumsum(self.times) - self.times)[order], self.times[order])
        return Items([x[order] for x in self.dense], self.times[order], [x[at] for x in self.ragged])

    def split(self, cuts: np.ndarray) -> list[Items]:
        """Cut before each of the places."""
        dense = [np.split(x, cuts) for x in self.dense]
        if self.times is None:
            return [Items(d) for d in zip(*dense)]
        far = np.concatenate([[0], np.cumsum(self.times)])[cuts]
        times, ragged = np.split(self.times, cuts), [np.split(x, far) for x in self.ragged]
        return [Items([d[k] for d in dense], t, [r[k] for r in ragged]) for k, t in enumerate(times)]

    def cells(self) -> list[bytes]:
        times = [] if self.times is None else [self.times.view(np.uint64)]
        return [_pack(x) for x in (*self.dense, *times, *self.ragged)]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def items_of(messages: list[list[bytes]], dense: int, ragged: int) -> Items:
    """The items of messages, one after the other."""
    if not messages:
        none = np.empty(0, np.uint64)
        return Items([none] * dense, none if ragged else None, [none] * ragged)
    cols = _joined([[_unpack(c) for c in m] for m in messages])
    return Items(cols[:dense], cols[dense] if ragged else None, cols[dense + 1 :])


class Net(NamedTuple):
    shards: int
    senders: int
    fan: int = FAN

    @property
    def levels(self) -> int:
        n = 1
        while self.fan**n < self.shards:
            n += 1
        return n

    @property
    def base(self) -> int:
        """The least base in which shards are numbers of `levels` digits: all first digits occur, about equally often."""
        n = 1
        while n**self.levels < self.shards:
            n += 1
        return n

    def shard_of(self, keys: np.ndarray, bits: int = 48) -> np.ndarray:
        """Shards of hashed keys by range, so that they ascend with the keys."""
        return (keys.astype(np.float64) * (self.shards / 2.0**bits)).astype(np.int64).clip(0, self.shards - 1)

    def group_of(self, block: int) -> int:
        """Which senders' messages are received together with those of this one."""
        return int(mixed(np.array([block], np.uint64))[0] % np.uint64(max(1, self.senders))) // self.base

    def to(self, level: int, shard: np.ndarray, group: int) -> np.ndarray:
        return (shard // self.base ** (self.levels - level) << _GROUP) | (group if level < self.levels else 0)


Row = tuple[int, int, list[int] | None, list[bytes]]


def deal(net: Net, level: int, sender: int, group: int, shard: np.ndarray, items: Items) -> Iterator[Row]:
    """Messages with the items, whose shards ascend."""
    if not len(shard):
        return
    to = net.to(level, shard, group)
    begin = starts(to)
    parts = items.split(begin[1:])
    for receiver, part, shards in zip(to[begin].tolist(), parts, np.split(shard, begin[1:])):
        head = [pack_ints(shards.view(np.uint64))] if level < net.levels else []
        yield receiver, sender, None, head + part.cells()


def ask(net: Net, block: int, shard: np.ndarray, items: Items) -> Iterator[Row]:
    """The block's messages; its items are in ascending order of shard."""
    return deal(net, 1, block, net.group_of(block), shard, items)


def note(block: int, columns: Sequence[np.ndarray]) -> Row:
    """A message of a block to itself."""
    return -1 - block, block, None, [_pack(x) for x in columns]


def table(rows: Sequence[Row]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["to", "frm", "stats", "items"])


def _by_sender(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: r["frm"])


def answer_of(rows: pa.Table, dense: int, ragged: int) -> Items:
    """A block's answers in the order in which it asked."""
    return items_of([r["items"] for r in _by_sender(rows) if r["items"] is not None], dense, ragged)


def converse(asked: DataFrame, answer: Callable[[int, Items], tuple[Items, list[int] | None]], net: Net, question: tuple[int, int], reply: tuple[int, int], written: bool = False) -> DataFrame:
    """Messages to blocks with the answers to asked.

    answer: what a shard makes of all items that came to it, one answer for each, and numbers of its own that are summed
    over the shards (in `stats`). question, reply: how many dense and ragged columns items have. Notes come back as they are.
    written: the messages are dealt out by block and written to the checkpoint folder.
    """

    def passed_on(level: int, wave: int, waves: int):
        def go(rows: pa.Table) -> pa.Table:
            to = rows.column("to")[0].as_py()
            if to < 0:
                return rows if wave == 0 else rows.slice(0, 0)
            got = _by_sender(rows)
            shard = np.concatenate([unpack_ints(r["items"][0]) for r in got]).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            order = order[shard[order] % waves == wave]
            items = items_of([r["items"][1:] for r in got], *question).take(order)
            out = list(deal(net, level + 1, to, (to & ((1 << _GROUP) - 1)) // net.base, shard[order], items))
            if wave == 0:
                out.append((_HELD - (level << _RECEIVER) - to, -1, None, [pack_ints(np.array([r["frm"] for r in got], np.uint64)), *[r["items"][0] for r in got]]))
            return table(out)

        return go

    def answered(rows: pa.Table) -> pa.Table:
        to = rows.column("to")[0].as_py()
        if to < 0:
            return rows
        got = _by_sender(rows)
        parts = [items_of([r["items"]], *question) for r in got]
        sizes, senders = [len(p) for p in parts], [r["frm"] for r in got]
        whole = Items(_joined([p.dense for p in parts]), np.concatenate([p.times for p in parts]) if question[1] else None, _joined([p.ragged for p in parts]))
        del parts, got  # each would be held beside the whole
        out, stats = answer(to >> _GROUP, whole)
        return table([(sender, to, None if k else stats, part.cells()) for k, (sender, part) in enumerate(zip(senders, out.split(np.cumsum(sizes)[:-1])))])

    def handed_back(rows: pa.Table) -> pa.Table:
        to = rows.column("to")[0].as_py()
        if to < 0:
            return rows
        (_, held), *told = ((r["frm"], r) for r in _by_sender(rows))  # the note comes first
        senders, shards = unpack_ints(held["items"][0]).tolist(), [unpack_ints(x).astype(np.int64) for x in held["items"][1:]]
        told = [r for _, r in told]
        back = np.empty(sum(map(len, shards)), np.int64)
        back[np.argsort(np.concatenate(shards), kind="stable")] = np.arange(len(back))
        items = items_of([r["items"] for r in told], *reply).take(back)
        sums = [r["stats"] for r in told if r["stats"] is not None]
        stats = np.sum(sums, axis=0).tolist() if sums else None
        return table([(sender, to, None if k else stats, part.cells()) for k, (sender, part) in enumerate(zip(senders, items.split(np.cumsum([len(s) for s in shards])[:-1])))])

    n = max(shuffle_partitions(asked.sparkSession), min(net.shards, MOST_PARTITIONS))
    if net.levels == 1:
        answers = asked.repartition(n, "to").groupBy("to").applyInArrow(answered, MESSAGE)
        waves = []
    else:
        flow = cut_by(asked, "to")
        for level in range(1, net.levels - 1):
            held, flow = flow, cut_by(flow.groupBy("to").applyInArrow(passed_on(level, 0, 1), MESSAGE), "to")
            release(held)
        last = [flow.groupBy("to").applyInArrow(passed_on(net.levels - 1, wave, WAVES), MESSAGE) for wave in range(WAVES)]
        waves = [cut_settled(x.repartition(n, "to").groupBy("to").applyInArrow(answered, MESSAGE)) for x in last]
        release(flow)
        answers = reduce(DataFrame.union, waves)
    for level in range(net.levels - 1, 0, -1):
        receiver = F.lit(_HELD - (level << _RECEIVER)) - F.col("to")
        own = F.when(receiver.between(0, (1 << _RECEIVER) - 1), receiver).otherwise(F.col("to"))
        answers = answers.withColumn("to", own).groupBy("to").applyInArrow(handed_back, MESSAGE)
    back = answers.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("to"), (F.col("to") < 0).alias("note"), "frm", "stats", "items")
    if not written:
        return back
    back = cut_by(back, "to")
    for wave in waves:
        release(wave)
    return back


def summed(messages: DataFrame) -> list[int]:
    """The shards' own numbers, summed; empty if there are none."""
    rows = messages.where("stats IS NOT NULL").select(F.posexplode("stats").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    return [r.n for r in sorted(rows)]
