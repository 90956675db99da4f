"""Tar archives as tables: an index of their headers, and the bytes of chosen members.

The index is a Python data source, a partition an archive: a walk reads headers and seeks over contents, and tests on the
member's name run where it walks. Contents are read by the index: its rows are joined with the wanted ones first and then
dealt by ranges of an archive, so several tasks read one plain archive and nothing else than what is wanted is read. A
compressed archive has no places to jump to; one task goes through it, and hands on the wanted members only.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
import tarfile
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of an archive that a task reads, of a batch of contents, and of a read ahead between headers.
SPLIT_BYTES, BATCH_BYTES, BUFFER = 128 << 20, 32 << 20, 1 << 18
SCHEMA = "archive string, member string, size long, at long, packed boolean"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("packed", pa.bool_())])
# The first bytes of compressed files.
PACKED: dict[bytes, Callable[[BinaryIO], Any]] = {b"\x1f\x8b": gzip.GzipFile, b"BZh": bz2.BZ2File, b"\xfd7zXZ\x00": lzma.LZMAFile}


def open_store(uri: str) -> BinaryIO:
    """A file in any store that Arrow knows, with a read-ahead that seeks drop."""
    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return io.BufferedReader(store.open_input_file(place), BUFFER)


def unpacked(raw: BinaryIO) -> tuple[Any, bool]:
    """The stream of the tar itself, and whether it had to be uncompressed."""
    first = raw.read(6)
    raw.seek(0)
    for magic, kind in PACKED.items():
        if first.startswith(magic):
            return (kind(fileobj=raw) if kind is gzip.GzipFile else kind(raw)), True
    return raw, False


def walk(stream: Any) -> Iterator[tuple[str, int, int]]:
    """(member, size, place of its content) of each plain file; only headers are read where the stream can seek."""
    with tarfile.open(fileobj=stream, mode="r:") as tar:
        while (info := tar.next()) is not None:
            tar.members = []  # it would keep all of them
            if info.isfile():
                yield info.name, info.size, info.offset_data


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarIndexReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.tests = paths, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests on the member's name; the rest goes back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("member",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)):
                self.tests.append(f)
            else:
                yield f

    def passes(self, name: str) -> bool:
        said = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith, StringContains: lambda v: v in name}
        return all(said[type(f)](f.value) for f in self.tests)

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        with open_store(partition.path) as raw:
            stream, packed = unpacked(raw)
            for member, size, at in walk(stream):
                if self.passes(member):
                    rows.append((partition.path, member, size, at, packed))
                if len(rows) == 10000:
                    yield _batch(rows, _ARROW)
                    rows = []
        if rows:
            yield _batch(rows, _ARROW)


class TarIndex(DataSource):
    """``spark.read.format("tar_index").option("paths", JSON list)``: the plain files of tar archives."""

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> TarIndexReader:
        return TarIndexReader(json.loads(self.options["paths"]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def tar_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, member, size, at, packed) of the plain files of these archives, a task an archive. Tests on ``member``
    (equality, isin, startswith, endswith, contains) run in the walk; this turns Spark's setting for that on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarIndex)
    return spark.read.format("tar_index").option("paths", json.dumps(paths)).load()


def contents(rows: Iterator[dict], opened: Callable[[str], BinaryIO] = open_store) -> Iterator[tuple[str, str, bytes]]:
    """(archive, member, content) of index rows sorted by archive and place: seeks forward, reads what is asked for."""
    now, raw, stream = None, None, None
    try:
        for row in rows:
            if row["archive"] != now:
                if raw is not None:
                    raw.close()
                now, raw = row["archive"], opened(row["archive"])
                stream, _ = unpacked(raw)
            stream.seek(row["at"])
            content = stream.read(row["size"])
            if len(content) != row["size"]:
                raise ValueError(f"{row['archive']} ends within {row['member']}")
            yield now, row["member"], content
    finally:
        if raw is not None:
            raw.close()


def read_indexed(index: DataFrame, archive_bytes: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, member, content) of the rows of an index, which may be any part of one. ``archive_bytes``: of all
    archives, which says into how many parts they are dealt. A cell holds 2 GB at most."""
    parts = max(1, -(-archive_bytes // split_bytes))
    chunk = F.when(F.col("packed"), 0).otherwise(F.floor(F.col("at") / split_bytes))
    dealt = index.repartition(parts, "archive", chunk).sortWithinPartitions("archive", "at")
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in contents(r for b in batches for r in b.to_pylist()):
            rows.append(row)
            held += len(row[2])
            if held >= BATCH_BYTES or len(rows) == 10000:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return dealt.select("archive", "member", "size", "at").mapInArrow(run, "archive string, member string, content binary")


def parsed_members(members: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each (member, content), in batches of 10,000; a member with none gives none."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for member, content in zip(batch.column("member"), batch.column("content")):
                for row in parse(member.as_py(), content.as_py()):
                    rows.append(row)
                    if len(rows) == 10000:
                        yield _batch(rows, types)
                        rows = []
        if rows:
            yield _batch(rows, types)

    return members.select("member", "content").mapInArrow(run, schema)
