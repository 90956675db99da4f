"""Archives by their index: what is read, by how many tasks, and what is refused."""

import bz2
import gzip
import io
import lzma
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from ligature.plans import files
from ligature.sources import archives, readers


def build(path, members, pack=lambda b: b):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("crossdocked/F")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
    path.write_bytes(pack(out.getvalue()))
    return str(path)


def members(n, seed=1):
    rnd = random.Random(seed)
    kinds = ["_rec.pdb", "_lig.pdb", ".txt"]
    # long names take further headers, and a member may be a tar itself
    return [(f"crossdocked/P{i % 5}/{'n' * (120 if i % 11 == 0 else 3)}{i}{kinds[i % 3]}", bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 511, 512, 5000])))) for i in range(n)]


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, bz2.compress, lzma.compress])
def test_members_of_every_kind_of_archive(spark, tmp_path, pack):
    inner = io.BytesIO()
    build(tmp_path / "inner.tar", members(3, 9))
    given = members(60) + [("crossdocked/P9/tar_lig.pdb", (tmp_path / "inner.tar").read_bytes())]
    del inner
    path = build(tmp_path / "a.bin", given, pack)
    for stream_bytes in (0, 1 << 30):
        found = readers.list_tar_members(spark, path, stream_bytes)
        assert {r["member"] for r in found.collect()} == {m for m, _ in given if m.endswith("pdb")}
        got = readers.read_tar_members(spark, path, found.filter("kind = 'lig'"), stream_bytes, split_bytes=20000).collect()
        assert sorted((r["member"], bytes(r["content"])) for r in got) == sorted(x for x in given if x[0].endswith("_lig.pdb"))


def test_two_tasks_read_one_archive(spark, tmp_path):
    path = build(tmp_path / "a.tar", [(f"m{i}", bytes([i]) * 4000) for i in range(60)])
    wanted = spark.createDataFrame([(f"m{i}",) for i in range(0, 60, 2)], "member string")
    out = readers.read_tar_members(spark, path, wanted, 0, split_bytes=16384).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 30 and all(bytes(r["content"]) == bytes([int(r["member"][1:])]) * 4000 for r in out)
    assert len({r["task"] for r in out}) > 4


class Counting(io.FileIO):
    taken = 0

    def readinto(self, buffer):
        n = super().readinto(buffer)
        Counting.taken += n
        return n


def test_unwanted_members_are_not_read(tmp_path, monkeypatch):
    path = build(tmp_path / "a.tar", [("big1", b"x" * (8 << 20)), ("small1", b"a" * 10), ("big2", b"y" * (8 << 20)), ("small2", b"b" * 10), ("big3", b"z" * (8 << 20))])
    monkeypatch.setattr(archives, "open_store", lambda p: io.BufferedReader(Counting(p), archives.BUFFER))
    Counting.taken = 0
    reader = archives.TarIndexReader([path])
    reader.tests = [archives.StringStartsWith(("member",), "small")]
    rows = [r for b in reader.read(archives.Archive(path)) for r in b.to_pylist()]
    assert [r["member"] for r in rows] == ["small1", "small2"] and Counting.taken < 2 << 20
    Counting.taken = 0
    out = list(archives.contents(iter(rows), archives.open_store))
    assert [c for *_, c in out] == [b"a" * 10, b"b" * 10] and Counting.taken < 1 << 20


def test_tests_on_names_run_in_the_walk(spark, tmp_path):
    path = build(tmp_path / "a.tar", members(30))
    index = archives.tar_index(spark, [path])
    for test in (F.col("member").endswith("_lig.pdb"), F.col("member").startswith("crossdocked/P1/"), F.col("member").contains("nnnn"), F.col("member").isin("no", members(30)[4][0])):
        want = {m for m, _ in members(30) if spark.createDataFrame([(m,)], "member string").filter(test).count()}
        assert {r["member"] for r in index.filter(test).collect()} == want and want
    reader = archives.TarIndexReader([path])
    left = list(reader.pushFilters([archives.EqualTo(("size",), 3), archives.EqualTo(("member",), "x")]))
    assert len(left) == 1 and len(reader.tests) == 1
    assert archives.tar_index(spark, []).count() == 0


def test_rows_of_members_and_broken_archives(spark, tmp_path):
    atom = "{:<6}{:>5} {:<4} {:>3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}\n"
    given = [(f"p{i}", "".join(atom.format("ATOM", k, "CA", "ALA", "A", k, k, i, 0.5) for k in range(i)).encode()) for i in range(5)]
    path = build(tmp_path / "a.tgz", given, gzip.compress)

    def atoms(member, content):
        for line in content.decode().splitlines():
            yield member, int(line[22:26]), float(line[38:46])

    wanted = spark.createDataFrame([("p3",), ("p4",), ("p0",)], "member string")
    rows = readers.parse_tar_members(spark, path, wanted, atoms, "member string, resnum int, y double").collect()
    assert sorted(map(tuple, rows)) == [(f"p{i}", k, float(i)) for i in (3, 4) for k in range(i)]
    with pytest.raises(ValueError, match="ends within"):
        list(archives.contents(iter([{"archive": str(tmp_path / "cut"), "member": "m", "at": 0, "size": 99}]), lambda p: io.BytesIO(b"short")))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pages_are_packed_in_archives_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 10000)
    path = files._archives(spark, "/root/testdata/sf0.001")
    listed = [r["path"] for r in readers.list_files(spark, path).collect()]
    held = archives.tar_index(spark, listed).groupBy("archive").agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n")).collect()
    assert len(listed) > 12 and all(r["s"] < 10000 + r["m"] for r in held)
    assert sum(r["n"] for r in held) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
