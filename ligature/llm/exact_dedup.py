"""Exact dedup by content-defined chunk recipes.

A document's recipe is its ordered list of chunk fingerprints. Documents with different recipes differ. For
those that share a recipe, the chunks are grouped by fingerprint and bytes, so that a fingerprint stands for
one content or is split into numbered variants; equal lists of such verified identifiers are equal texts.
Only chunks of documents that share a recipe are moved, and of equal chunks one a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rolling_hashes, ship, text_block, slices

#: A cut needs so many bytes before it to hash to a multiple of MEAN; chunks have MIN bytes at least, MAX at most.
WINDOW, MEAN, MIN, MAX = 48, 2048, 512, 16384


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one document; the bytes near a cut alone decide about it."""
    if len(data) <= MIN:
        return [len(data)]
    marks = np.flatnonzero((rolling_hashes(data, WINDOW) & np.uint64(MEAN - 1)) == 0) + WINDOW
    out, last = [], 0
    for mark in [*marks.tolist(), len(data)]:
        while mark - last > MAX:
            last += MAX
            out.append(last)
        if mark - last >= MIN or mark == len(data) > last:
            out.append(mark)
            last = mark
    return out


def fingerprint(chunk: bytes, bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True) >> (64 - bits)


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, recipe) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            digests, lists = [], []
            view = memoryview(raw)
            for i in range(batch.num_rows):
                one = raw[offs[i] : offs[i + 1]]
                digests.append(hashlib.sha256(view[offs[i] : offs[i + 1]]).hexdigest())
                ends = cut_points(one)
                lists.append([fingerprint(one[a:b].tobytes(), bits) for a, b in zip([0, *ends[:-1]], ends)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "text_sha256", "recipe"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string, recipe array<long>")


def chunks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, pos, mark, chunk) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in slices(offs):
                rows = []
                for i in range(lo, hi):
                    one = raw[offs[i] : offs[i + 1]]
                    ends = cut_points(one)
                    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                        rows.append((ids[i], k, fingerprint(c := one[a:b].tobytes(), bits), c))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "pos", "mark", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, mark long, chunk binary")


def exact_groups(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each document: of equal texts the largest doc_id stays.

    Null counts as empty, and empty texts are equal to each other. Repeated rows count each, and stay
    or go together; a row with a null doc_id never stays if another has its text. Further columns are left out. ``bits``: of a fingerprint; few bits make collisions, for tests.
    """
    ship(docs.sparkSession)
    lists = materialise(recipes(docs, bits), "recipes")
    shared = materialise(lists.groupBy("n_bytes", "recipe").count().filter("count > 1").select("n_bytes", "recipe"), "shared-recipes")
    suspects = materialise(lists.join(shared, ["n_bytes", "recipe"], "left_semi").select("doc_id"), "suspects")
    stored = chunks(docs.select("doc_id", "text").join(suspects, "doc_id", "left_semi"), bits)
    contents = stored.groupBy("mark", "chunk").agg(F.min("doc_id").alias("doc_id"))
    # fingerprints with more than one content, each content numbered; none is expected at 64 bits
    clashing = contents.groupBy("mark").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("chunk")).alias("contents")).filter("n > 1")
    clashing = materialise(clashing.select("mark", F.posexplode("contents").alias("variant", "chunk")), "clashing-chunks")
    if clashing.isEmpty():
        named = lists.withColumn("variants", F.array().cast("array<struct<pos:int,variant:int>>"))
    else:
        split = stored.join(clashing, ["mark", "chunk"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("variants"))
        named = materialise(lists.join(split, "doc_id", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<struct<pos:int,variant:int>>"))), "verified-recipes")
    key = ["n_bytes", "recipe", "variants"]
    groups = materialise(named.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "equal-texts")
    return named.join(groups, key).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
"""
