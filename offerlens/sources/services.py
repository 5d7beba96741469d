"""Landed answers of services as a data source: `spark.read.format("landed")`, files dealt to partitions as Spark deals its own, predicates pushed to it.

A file is one answer, JSON of a list or of an object that holds one, or several with a line for each, in a folder named by the area that was asked about:
`<path>/area=<area>/<file>`. Predicates on `area` choose the files, so the others aren't opened; those on other columns are tried on each record
before it becomes a row. A predicate that the source can't judge stays with Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

AREA = "area"
#: Of each kind of answer: where its records are, and its columns with their ways into a record; the first way that leads to a value counts.
KINDS: dict[str, tuple[str | None, list[tuple[str, str, tuple[tuple[str, ...], ...]]]]] = {
    "elements": (
        "elements",
        [
            ("kind", "string", (("type",),)), ("id", "bigint", (("id",),)), ("name", "string", (("tags", "name"),)), ("website", "string", (("tags", "website"), ("tags", "contact:website"))),
            ("number", "string", (("tags", "addr:housenumber"),)), ("street", "string", (("tags", "addr:street"),)), ("zip", "string", (("tags", "addr:postcode"),)),
            ("lat", "double", (("lat",), ("center", "lat"))), ("lng", "double", (("lon",), ("center", "lon"))),
        ],
    ),
    "places": (
        "places",
        [
            ("place_id", "string", (("id",),)), ("place_name", "string", (("displayName", "text"),)), ("place_address", "string", (("formattedAddress",),)), ("website", "string", (("websiteUri",),)),
            ("primary_type", "string", (("primaryType",),)), ("lat", "double", (("location", "latitude"),)), ("lng", "double", (("location", "longitude"),)),
        ],
    ),
    "geocodes": (None, [("query", "string", (("query",),)), ("lat", "double", (("lat",),)), ("lng", "double", (("lon",),)), ("precision", "string", (("addresstype",), ("type",))), ("shown", "string", (("display_name",),))]),
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
_CAST = {"string": str, "bigint": int, "double": float}


@dataclass
class File:
    path: str
    area: str
    size: int


@dataclass
class Files(InputPartition):
    files: list[File]


#: Bytes of a partition at most, and what opening a file counts for; Spark's own defaults.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 4 << 20


def dealt(files: Sequence[File], cores: int) -> list[Files]:
    """files in partitions of about one size: as many as there are cores, more if they were too large."""
    weight = [f.size + OPEN_BYTES for f in files]
    most = min(PARTITION_BYTES, max(OPEN_BYTES, sum(weight) // cores))
    out, held = [], most
    for file, w in zip(files, weight):
        if held + w > most:
            out.append(Files([]))
            held = 0
        out[-1].files.append(file)
        held += w
    return out


def area_of(path: str) -> str:
    """The area of a file's address, which is encoded as an address over the encoding of a folder's value."""
    return next((unquote(unquote(p[len(AREA) + 1 :])) for p in path.replace("%3D", "=").split("/") if p.startswith(f"{AREA}=")), "")


def judge(test: Filter, row: dict[str, Any]) -> bool:
    """Whether a record passes; null passes no comparison."""
    value = row.get(test.attribute[0])
    if isinstance(test, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, (GreaterThan, GreaterThanOrEqual)):
        return value > test.value or isinstance(test, GreaterThanOrEqual) and value == test.value
    if isinstance(test, (LessThan, LessThanOrEqual)):
        return value < test.value or isinstance(test, LessThanOrEqual) and value == test.value
    return True  # IsNotNull


JUDGED = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull, IsNull)


class Reader(DataSourceReader):
    def __init__(self, kind: str, listed: Sequence[tuple[str, int]], cores: int):
        self.kind, self.files, self.tests, self.cores = kind, [File(p, area_of(p), n) for p, n in listed], [], cores

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if not isinstance(test, JUDGED) or len(test.attribute) != 1:
                yield test
            elif test.attribute[0] == AREA:
                self.files = [f for f in self.files if judge(test, {AREA: f.area})]
            else:
                self.tests.append(test)

    def partitions(self) -> Sequence[Files]:
        # the reader goes to every task, and each has its files by then
        out, self.files = dealt(self.files, self.cores) or [Files([])], None
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for file in partition.files:
            yield self._rows(file)

    def _rows(self, file: File) -> pa.RecordBatch:
        listed, columns = KINDS[self.kind]
        out: dict[str, list] = {AREA: [], **{name: [] for name, _, _ in columns}}
        for record in records(file.path, listed):
            row = {AREA: file.area, **{name: _value(record, kind, ways) for name, kind, ways in columns}}
            if all(judge(t, row) for t in self.tests):
                for name, value in row.items():
                    out[name].append(value)
        types = {AREA: pa.string(), **{name: _ARROW[kind] for name, kind, _ in columns}}
        return pa.RecordBatch.from_pydict({n: pa.array(v, types[n]) for n, v in out.items()})


def records(path: str, listed: str | None) -> list[dict]:
    """The records of a file's answers; an answer that is no JSON, or holds none, has none."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inside) as file:
        text = file.read().decode("utf-8", "replace")
    try:
        answers = [json.loads(text)]
    except ValueError:
        answers = list(map(_answer, text.split("\n")))
    lists = [a.get(listed) if listed and isinstance(a, dict) else a for a in answers]
    return [r for found in lists if isinstance(found, list) for r in found if isinstance(r, dict)]


def _answer(line: str) -> Any:
    try:
        return json.loads(line)
    except ValueError:
        return None


def _value(record: dict, kind: str, ways: tuple[tuple[str, ...], ...]) -> Any:
    for way in ways:
        at: Any = record
        for key in way:
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            try:
                return _CAST[kind](at)
            except (TypeError, ValueError):
                continue
    return None


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return ", ".join([f"{AREA} string", *[f"{name} {kind}" for name, kind, _ in KINDS[self.options["kind"]][1]]])

    def reader(self, schema) -> Reader:
        return Reader(self.options["kind"], json.loads(self.options["files"]), int(self.options["cores"]))


def landed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The answers of that kind below path; the files are listed by Spark's own file system, and opened by their full addresses."""
    spark.dataSource.register(Landed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{AREA}=*/*")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top) or []
    files = [(s.getPath().toUri().toString(), s.getLen()) for s in found if not s.getPath().getName().startswith(("_", "."))]
    return spark.read.format("landed").option("kind", kind).option("files", json.dumps(files)).option("cores", str(spark.sparkContext.defaultParallelism)).load()
