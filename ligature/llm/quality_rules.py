"""Quality rules: counted base rules, then a hashed word and character n-gram logistic regression.

The regression learns from labelled rows, is calibrated on a part of them that it hasn't seen (Platt), and
scores whole texts in Arrow batches against a fixed threshold. A text's features are the shares of each word,
word pair and character triple among its own, so long and short texts are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, ship, slices, span_hashes, span_numbers, sums_by_row, text_block, word_spans

BITS = 17
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass
class Model:
    """Weights by hash, bias, and the calibration p = 1 / (1 + exp(-(slope * z + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def grams(raw: np.ndarray, offs: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three families of hashed features: (index of each occurrence, first occurrence of each row), from the words'
    ``hashes`` and each row's ``first`` word."""
    keep = np.uint64((1 << BITS) - 1)
    out = []
    out.append(((hashes & keep).astype(np.int32), first))
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    inside = np.ones(len(pairs), bool)
    inside[first[1:-1][(first[1:-1] > 0) & (first[1:-1] <= len(pairs))] - 1] = False
    where = np.concatenate([[0], np.cumsum(inside)])
    out.append(((pairs[inside] & keep).astype(np.int32), where[np.minimum(first, len(pairs))]))
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    if len(points) > 2:
        triples = mix(points[:-2] * np.uint64(0x1000003) + points[1:-1] * np.uint64(0x10001) * np.uint64(31) + points[2:] * np.uint64(0x9E3779B1))
        inside = np.ones(len(triples), bool)
        for back in (1, 2):
            edge = place[1:-1] - back
            inside[edge[(edge >= 0) & (edge < len(triples))]] = False
        where = np.concatenate([[0], np.cumsum(inside)])
        out.append(((triples[inside] & keep).astype(np.int32), where[np.minimum(place, len(triples))]))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(len(offs), np.int64)))
    return out


def base_counts(raw: np.ndarray, offs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row; ``h``: the words' hashes."""
    starts, ends, first = words
    rows, n = len(offs) - 1, np.diff(first)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = sums_by_row(points[ends] - points[starts], first)
    symbols = sums_by_row(SYMBOLS[raw].astype(np.int64), offs)
    # lines: between line feeds and row ends
    feeds = np.flatnonzero(raw == 10)
    edge_starts, edge_ends = np.union1d(feeds + 1, offs[:-1]), None
    edge_starts = edge_starts[edge_starts < len(raw)]
    row_end = offs[np.searchsorted(offs, edge_starts, "right")]
    after = np.searchsorted(feeds, edge_starts)
    edge_ends = np.minimum(np.append(feeds, len(raw))[after], row_end)
    with_word = np.searchsorted(starts, edge_starts) < np.searchsorted(starts, edge_ends)
    ls, le = edge_starts[with_word], edge_ends[with_word]
    line_row = np.searchsorted(offs, ls, "right") - 1
    lines = span_numbers(raw, ls, le)
    order = np.lexsort((lines, line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    dup = np.bincount(line_row[order][again], minlength=rows)
    # words in windows of three that occur again in the row
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 2:
        row = np.repeat(np.arange(rows), n)
        at = np.flatnonzero(row[:-2] == row[2:])
        word = np.unique(span_numbers(raw, starts, ends, h), return_inverse=True)[1]
        windows = row[at]
        for k in range(3):  # exact numbers: of the row and the words so far
            windows = np.unique(windows * len(starts) + word[at + k], return_inverse=True)[1]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[hit + k] = True
        repeat[1:] = np.cumsum(covered)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat[first[1:]] - repeat[first[:-1]]}


def sparse(raw: np.ndarray, offs: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each row its different features, 2**BITS at most, and their shares, summed over the families."""
    families = grams(raw, offs, first, hashes)
    idx, share = [], []
    for i in range(len(offs) - 1):
        own = [x[b[i] : b[i + 1]] for x, b in families]
        place, at = np.unique(np.concatenate(own), return_inverse=True)
        idx.append(place)
        share.append(np.bincount(at, np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in own]), len(place)).astype(np.float32))
    return idx, share


def dense(weights: np.ndarray, bias: float, raw: np.ndarray, offs: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each row's sum of weighted shares and bias."""
    z = np.full(len(offs) - 1, bias)
    for idx, bounds in grams(raw, offs, first, hashes):
        z += sums_by_row(weights[idx].astype(np.float64), bounds) / np.maximum(1, np.diff(bounds))
    return z


def evidence(docs: DataFrame) -> DataFrame:
    """Sparse features of labelled documents: (doc_id, y, n, idx, share), of which a text has 2**BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offs_all = text_block(batch.column("text"))
            for lo, hi in slices(offs_all):
                raw, offs = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                words = word_spans(raw, offs)
                idx, share = sparse(raw, offs, words[2], span_hashes(raw, *words[:2]))
                n = pa.array([len(x) for x in idx], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("y")[lo:hi], n, pa.array(idx, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["doc_id", "y", "n", "idx", "share"])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, n long, idx array<int>, share array<float>")


def bounded(rows: DataFrame, most_entries: int) -> DataFrame:
    """Those first ``rows`` of evidence(), by the hashes of their ids, that have ``most_entries`` entries in all."""
    by_hash = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of a bounded sample, without its features
    some = rows.select("doc_id", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)).alias("sum")).filter(F.col("sum") <= most_entries)
    return rows.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")


def stretch_sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each key below ``n``; keys ascend."""
    out = np.zeros(n)
    if len(key):
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out[key[at]] = np.add.reduceat(values, at, dtype=np.float64)
    return out


def descend(idx: np.ndarray, share: np.ndarray, row: np.ndarray, y: np.ndarray, steps: int, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full gradients with a step size of its own for each weight (AdaGrad); ``row`` ascends."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-12), 0.0, 1e-12
    n = max(1, len(y))
    # entries by feature too: sums of sorted stretches are faster than scattered ones
    by_idx = np.argsort(idx, kind="stable").astype(np.int32)
    row_by, share_by, idx_by = row[by_idx], share[by_idx], idx[by_idx]
    del by_idx
    for _ in range(steps):
        z = stretch_sums(w.astype(np.float32)[idx] * share, row, len(y))
        error = (1 / (1 + np.exp(-np.clip(z + bias, -40, 40))) - y) / n
        g = stretch_sums(error.astype(np.float32)[row_by] * share_by, idx_by, 1 << BITS) + decay * w / n
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = error.sum()
        b2 += gb * gb
        bias -= 0.3 * gb / np.sqrt(b2)
    return w, bias


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with Platt's softened targets; the slope stays positive."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d, v = p - t, p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        a = max(a, 0.05)
    return float(a), float(b)


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents, those whose ids have the smallest hashes."""
    some = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, steps: int = 60, most_entries: int = 1 << 23) -> Model:
    """Fit on four fifths of a bounded sample of labelled rows, calibrate on the fifth. Without both kinds of
    labels, every text gets the probability 1.

    The sample has ``most`` rows at most, whole texts, and so many of them that their features have ``most_entries``
    entries (of eight bytes, on the driver) at most; a text has 2**BITS at most, so 64 texts always fit.
    """
    ship(docs.sparkSession)
    rows = bounded(materialise(evidence(labelled(docs, labels, most)), "labelled-features"), most_entries).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 40.0)
    held = mix(rows.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(5) == 0
    lists, shares = rows.column("idx").combine_chunks(), rows.column("share").combine_chunks()
    del rows  # the features are held once from here on
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    idx, share = lists.flatten().to_numpy(), shares.flatten().to_numpy()
    own = ~held[row]
    number = (np.cumsum(~held) - 1).astype(np.int32)
    w, bias = descend(idx[own], share[own], number[row[own]], y[~held], steps)
    z = stretch_sums(w.astype(np.float32)[idx] * share, row, len(y)) + bias
    slope, shift = platt(z[held], y[held]) if held.any() else (1.0, 0.0)
    return Model(w.astype(np.float32), float(bias), slope, shift)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Base counts, base_failed, the probability of good quality, and kept, for each document.

    A null or empty text has no words and fails the base rules, as does a text of fewer than 50 words or with
    more than half of its words in repeated windows of three. Further columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw_all, offs_all = text_block(batch.column("text"))
            for lo, hi in slices(offs_all):
                raw, offs = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                words = word_spans(raw, offs)
                h = span_hashes(raw, *words[:2])
                base = base_counts(raw, offs, words, h)
                p = own.probability(dense(own.weights, own.bias, raw, offs, words[2], h))
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], *[pa.array(base[x], pa.int64()) for x in names], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                    ["doc_id", *names, "base_failed", "p_quality", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean")


def apply_rules(docs: DataFrame, labels: DataFrame, most: int = 4000, threshold: float = 0.5) -> DataFrame:
    return score(docs, fit(docs, labels, most), threshold)
