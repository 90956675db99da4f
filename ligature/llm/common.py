"""What the text operators share: shared-folder tables, text blocks in numpy, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy kernels handle at once; a longer document is handled alone.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the master is local, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors,
    and gives later joins a true size to decide on."""
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Subfolders of the tables' folder that passing_tables() has opened.
_INSIDE: ContextVar[tuple[str, ...]] = ContextVar("inside", default=())


def tables_folder(spark: SparkSession) -> str:
    return "/".join([shared_folder(spark), "tables", spark.sparkContext.applicationId, *_INSIDE.get()])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark wrote, in whatever store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that materialise() wrote in this application; results that still read them are lost."""
    remove(spark, tables_folder(spark))


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside are deleted at its end, and no others: write the result inside too."""
    opened = _INSIDE.set((*_INSIDE.get(), uuid.uuid4().hex))
    folder = tables_folder(spark)
    try:
        yield
    finally:
        _INSIDE.reset(opened)
        remove(spark, folder)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a session."""
    if spark.conf.get("ligature.shipped", "") == spark.sparkContext.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ligature.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("ligature.shipped", spark.sparkContext.applicationId)


def text_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


_POWERS: dict[int, np.ndarray] = {}
#: Odd multiplier of the rolling hash and its inverse mod 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that ``span_hashes`` folds one after the other, and the masks of the last of them.
LEAF = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_TABLE = np.random.RandomState(20240501).randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)


def powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:  # longer tables serve one long document and go
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Of a polynomial modulo 2**64: good for choosing places, not for telling texts apart."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data), _BASE), out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand.

    Eight bytes at a time go through ``mix``, all spans side by side. A span longer than LEAF bytes is cut into leaves
    of that size, and the leaves' hashes are hashed in the same way, so no span takes more than LEAF / 8 steps a level.
    """
    size = np.asarray(ends - starts, np.int64)
    leaves = np.maximum(1, -(-size // LEAF))
    first = np.cumsum(leaves) - leaves
    inside = (np.arange(int(leaves.sum())) - np.repeat(first, leaves)) * LEAF
    at, rest = np.repeat(starts, leaves) + inside, np.minimum(np.repeat(size, leaves) - inside, LEAF)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))  # the eight bytes at each place
    out = rest.astype(np.uint64) * np.uint64(_BASE)
    live = np.arange(len(at))
    for step in range(0, LEAF, 8):
        live = live[rest[live] > step]
        if not len(live):
            break
        value = words[at[live] + step] & _MASKS[np.minimum(rest[live] - step, 8)]
        out[live] = mix(out[live] * np.uint64(31) + value)
    hashes = out[first]
    long = np.flatnonzero(leaves > 1)
    if len(long):
        hashes[long] = mix(span_hashes(out.view(np.uint8), first[long] * 8, (first[long] + leaves[long]) * 8) + size[long].astype(np.uint64))
    return hashes


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Numbers of spans that are equal exactly where the spans' bytes are: hashes bring them together, bytes decide."""
    hashes = span_hashes(data, starts, ends) if hashes is None else hashes
    order = np.argsort(hashes, kind="stable")
    size = np.asarray(ends - starts, np.int64)[order]
    like = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    equal = size[like] == size[like + 1]
    for lo, hi in slices(np.append(0, np.cumsum(np.where(equal, size[like], 0)))):
        at = like[lo:hi][equal[lo:hi]]
        n = size[at]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[order[at]], n) + inside] != data[np.repeat(starts[order[at + 1]], n) + inside]
        wrong = np.add.reduceat(np.append(differ, False), np.minimum(np.cumsum(n) - n, len(differ))) if len(at) else np.zeros(0)
        equal[lo:hi][equal[lo:hi]] = (wrong == 0) | (n == 0)
    new = np.ones(len(order), bool)
    new[like[equal] + 1] = False
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new)
    if not equal.all():  # different spans with one hash: each of that hash by its bytes
        of: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(hashes, hashes[order[like[~equal]]])).tolist():
            numbers[i] = -1 - of.setdefault(data[starts[i] : ends[i]].tobytes(), len(of))
    return numbers


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of ``width`` bytes, to choose places by; see prefix_sums()."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    return mix((sums[width:] - sums[:n]) * powers(n, _INVERSE))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (rows + 1)."""
    space = _IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; ``bounds`` has rows + 1 places."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Forest:
    """Union of positions 0..n-1 with the smallest as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of an undirected graph (a, b): component is the smallest node.

    Alternating large-star and small-star steps; minima are partial aggregates, so hubs don't gather in one
    task, and every round is a table in the shared folder. Edges always point down, so it is over once each node that
    points anywhere points at one node only, which itself points nowhere. Nodes without edges are not returned.
    """

    def star(both: DataFrame, pairs: DataFrame) -> DataFrame:
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))

    def unsettled(pairs: DataFrame) -> bool:
        ends = pairs.select(F.inline(F.expr("array(struct(u as n, 1L as up, 0L as down), struct(v as n, 0L as up, 1L as down))")))
        nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return bool(nodes.agg(F.bool_or(F.expr("up > 1 or up > 0 and down > 0"))).first()[0])

    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{label}-edges")
    while unsettled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, f"{label}-large")
        small = star(large, large)
        now = materialise(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), f"{label}-small")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
