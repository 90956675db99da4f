"""Periodic runs of words by minimizers at several scales.

A run is a maximal stretch of words with smallest period q that holds q at least ``times`` times. Periods up to SHORT
are found by lag scans: where do words q apart agree? For the periods in (w/2, w], w = 16, 32, ..., take the spans of w
words. In a run of such a period two spans are equal exactly if they stand a multiple of the period apart, so the
smallest spans of the windows of w/2 places, its minimizers, come again one period later, and no equal one stands
between. So neighbours among equal minimizers that lie in (w/2, w] apart are seeds, each run has one, and a seed is
extended by comparing words. A document's work is its words times the number of scales, besides the runs themselves.

Spans have exact numbers rather than hashes (the number of a span is that of the pair of its halves), so none is lost to a
collision. Spans that occur once in their document start no run, nor do stretches of others too short for one; both
leave at each scale, which in plain text leaves almost nothing after the first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship, slices, text_block

#: Longest period that lag scans look for; the first scale of minimizers is twice that.
SHORT = 8
#: A run holds its period so many times, and so many words, at least.
TIMES, LEAST = 4, 6
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def stretches(yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    change = np.flatnonzero(np.diff(np.concatenate([[False], yes, [False]]).astype(np.int8)))
    return change[::2], change[1::2]


def slid(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours, a power of two, from their first on; short at the end."""
    pick, have = np.minimum if least else np.maximum, 1
    while have < width and have < len(values):
        values = np.concatenate([pick(values[:-have], values[have:]), values[-have:]])
        have *= 2
    return values


def minimizers(marks: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest mark of one of the windows of ``width`` places around them."""
    if len(marks) < width:
        return np.zeros(0, np.int64)
    least = slid(marks, width, True)[: len(marks) - width + 1]  # of the window that starts at each place
    edge = np.zeros(width - 1, np.uint64)
    best = slid(np.concatenate([edge, least, edge]), width, False)[: len(marks)]  # largest minimum of the windows around
    return np.flatnonzero((best == marks) & (marks != _LAST))


def extend(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are equal, as [start, end)."""

    def reach(a: np.ndarray, b: np.ndarray) -> int:
        done, step, n = 0, 64, min(len(a), len(b))
        while done < n:
            differ = np.flatnonzero(a[done : min(n, done + step)] != b[done : min(n, done + step)])
            if len(differ):
                return done + int(differ[0])
            done, step = done + step, 2 * step
        return n

    right = reach(words[at:], words[at + period :])
    left = reach(words[:at][::-1], words[: at + period][::-1])
    return at - left, at + right + period


def find_runs(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) by start and period of numbered words; ``times`` is 4 at least, as the proof needs."""
    found = []
    for period in range(1, SHORT + 1):
        if len(words) > period:
            a, b = stretches(words[:-period] == words[period:])
            enough = b - a + period >= max(least, times * period)
            found.append(np.stack([a[enough], b[enough] + period, np.full(enough.sum(), period)], 1))
    number = np.unique(words, return_inverse=True)[1].astype(np.int64)
    kept, width = np.arange(len(words)), 1
    while len(kept):
        counts = np.bincount(number[kept])
        kept = kept[counts[number[kept]] > 1]
        # a run of a period that is left has this many spans in a row
        shortest = times * max(SHORT + 1, width // 2 + 1) - width + 1
        alive = np.zeros(len(words), bool)
        alive[kept] = True
        a, b = stretches(alive)
        for x, y in zip(a[b - a < shortest], b[b - a < shortest]):
            alive[x:y] = False
        kept = np.flatnonzero(alive)
        if width > SHORT and len(kept):
            found.append(runs_at_scale(words, number, kept, width, times))
        after = kept[kept + width < len(words)]
        after = after[alive[after + width]]
        pair = number[after] * (len(words) + 1) + number[after + width]
        number = np.full(len(words), -1, np.int64)
        number[after] = np.unique(pair, return_inverse=True)[1]
        kept, width = after, 2 * width
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    # the same stretch with a multiple of its period is no run of its own
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    runs[:, 1] -= runs[:, 0]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_at_scale(words: np.ndarray, number: np.ndarray, kept: np.ndarray, width: int, times: int) -> np.ndarray:
    """Rows (start, end, period) of the stretches with periods in (width / 2, width]."""
    marks = np.full(len(words), _LAST)
    marks[kept] = mix(number[kept].astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
    chosen = minimizers(marks, width // 2)
    chosen = chosen[np.lexsort((chosen, number[chosen]))]
    gap = np.diff(chosen)
    seeds = (number[chosen[1:]] == number[chosen[:-1]]) & (gap > width // 2) & (gap <= width)
    at, period = chosen[:-1][seeds], gap[seeds]
    out = []
    for q in np.unique(period).tolist():
        places, k = np.sort(at[period == q]), 0
        while k < len(places):
            a, b = extend(words, int(places[k]), q)
            if b - a >= times * q:
                out.append((a, b, q))
            k = int(np.searchsorted(places, b - q))  # the seeds up to there are in the same stretch
    return np.array(out, np.int64).reshape(-1, 3)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the repetition that its id plants: one in ten, by crc32 of the decimal id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def collapse(docs: DataFrame, plant: bool = False, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, n_words, kept) of each document.

    ``kept`` has the words that no run holds after its first period, joined by one space. Null and empty texts have no
    words, no runs and empty ``kept``; a row with a null doc_id is read as it is, nothing is planted; repeated rows are
    documents of their own; further columns are left out. Whole texts are read, and a document is one row, so nothing is
    shuffled and a lost task repeats its own rows only. A very long document takes memory of some 150 bytes a word.
    """
    if times < TIMES:
        raise ValueError(f"runs hold their period {TIMES} times at least")
    ship(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def block(words: list[list[bytes]]) -> list[tuple[np.ndarray, bytes]]:
        """Runs and kept words of some documents at once: equal words of different documents get different numbers."""
        ids: dict[bytes, int] = {}
        flat = np.array([ids.setdefault(w, len(ids)) for own in words for w in own], np.int64)
        sizes = np.array([len(own) for own in words], np.int64)
        first = np.cumsum(sizes) - sizes
        runs = find_runs(flat + np.repeat(np.arange(len(words)), sizes) * (len(ids) + 1), times, least)
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        gone, edges, out = np.cumsum(change) > 0, np.searchsorted(runs[:, 0], np.append(first, len(flat))), []
        for k, own in enumerate(words):
            of = runs[edges[k] : edges[k + 1]]
            stay = b" ".join(w for w, x in zip(own, gone[first[k] : first[k] + len(own)].tolist()) if not x) if len(of) else b" ".join(own)
            out.append((of - [first[k], 0, 0], stay))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_block(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in slices(offs):
                words = [raw[offs[i] : offs[i + 1]].tobytes().split() for i in range(lo, hi)]  # at ASCII white space
                if plant:
                    words = [planted(own, i) for own, i in zip(words, ids[lo:hi])]
                done = block(words)
                listed = [[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs, _ in done]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(listed, run_type), pa.array(map(len, words), pa.int64()), pa.array([k.decode() for _, k in done], pa.string())],
                    ["doc_id", "runs", "n_words", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, n_words long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """The number of runs, the longest (ties: smallest start, then period) and digests, with planted repetitions."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = collapse(docs, plant=True).withColumn("_l", longest)
    start, length, period = -F.col("_l.start"), F.col("_l.length"), -F.col("_l.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
