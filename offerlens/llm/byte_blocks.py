"""Documents gathered into blocks of a few MB: one row, one compressed body, so that work on all of them is done by numpy at once.

A block is the unit of question and answer: it asks shards about its keys, each once, and gets one
answer per shard, however often a key recurs in the block. So a key that a third of all documents
hold costs its shard one entry per block, not one per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from offerlens.llm.common import cut, id_and_bytes, shuffle_partitions

BLOCK_BYTES = 3 << 20
#: Stands for a null id in comparisons; the largest, so that nothing is a copy of it. Which rows have none is kept besides.
NO_ID = (1 << 63) - 1

SCHEMA = "block long, n_bytes long, ids binary, sizes binary, body binary, named binary"


def squeeze(data: bytes | memoryview) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RISING = 16


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, compressed by byte planes; ascending ones by their differences."""
    values = values.astype("<u8")
    rising = len(values) > 1 and bool((values[1:] >= values[:-1]).all())
    if rising:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    top = 8
    while top > 1 and not planes[top - 1].any():
        top -= 1
    return bytes([top + _RISING * rising]) + squeeze(planes[:top].tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    rising, top = divmod(data[0], _RISING)
    raw = np.frombuffer(expand(data[1:]), np.uint8)
    n = len(raw) // top
    out = np.zeros((n, 8), np.uint8)
    out[:, :top] = raw.reshape(top, n).T
    values = out.reshape(-1).view("<u8")
    return np.cumsum(values, dtype=np.uint64) if rising else values


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    bodies: list[bytes] = []
    held = made = 0
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def row() -> pa.RecordBatch:
        body = b"".join(bodies)
        keys = np.array([NO_ID if k is None else k for k in ids], "<i8").tobytes()
        named = np.packbits([k is not None for k in ids]).tobytes()
        cells = [first + made, len(body), keys, np.array([len(b) for b in bodies], "<i8").tobytes(), squeeze(body), named]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array([c], t) for c, t in zip(cells, types)], names=["block", "n_bytes", "ids", "sizes", "body", "named"])

    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(key)
            bodies.append(bytes(body.as_buffer()))
            held += len(bodies[-1])
            if held >= BLOCK_BYTES or len(ids) >= 50_000:
                yield row()
                ids, bodies, held, made = [], [], 0, made + 1
    if ids:
        yield row()


def cut_settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder; plans that read it know how it is dealt out.

    Only a plan that is fixed before it runs passes its partitioning on; and what it shuffled is let go when it is written. Hence the settings meanwhile,
    and a plan of its own: one that was made before does not know them.
    """
    conf = df.sparkSession.conf
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: conf.get(name, "false") for name in settings}
    try:
        for name, value in settings.items():
            conf.set(name, value)
        return cut(df.select("*"))
    finally:
        for name, value in before.items():
            conf.set(name, value)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key and written to the checkpoint folder."""
    return cut_settled(df.repartition(shuffle_partitions(df.sparkSession), key))


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block, written to the checkpoint folder, so that block numbers stay.

    It is dealt out by block before that, and keeps this partitioning: what is grouped with it by
    block later moves to it, and the texts don't move again.
    """
    return cut_by(id_and_bytes(docs).mapInArrow(_gather, SCHEMA), "block")


def named_rows(row: dict) -> list[bool]:
    """Of each document of a block: whether it has an id."""
    return np.unpackbits(np.frombuffer(row["named"], np.uint8), count=len(row["ids"]) // 8).astype(bool).tolist()


def open_block(ids: bytes, sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bytes) of a block: ends[i] is where document i ends."""
    return np.frombuffer(ids, "<i8"), np.cumsum(np.frombuffer(sizes, "<i8")), np.frombuffer(expand(body), np.uint8)
