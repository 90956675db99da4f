"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic regression gives each document's own evidence, from the score of a hashed n-gram model and a few counted
shares. Hosts and the paths within them have quality rates of their own; the rates of sparse sites are shrunk, paths
towards their host and hosts towards the whole corpus, by strengths estimated from how far the rates scatter. A
document's posterior takes its site's rate, without its own part in it, as the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, ship, slices, span_hashes, sums_by_row, text_block, word_spans
from .quality_rules import BITS, base_counts, bounded, dense, descend, labelled, platt, sparse, stretch_sums

CLASSES = [np.isin(np.arange(256), np.frombuffer(x, np.uint8)).astype(np.int64) for x in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!?", b"|", b"#*$%&<>@_~^=+{}[]\\/")]
N_SHARES = 12


@dataclass
class Evidence:
    """Weights of the hashed n-grams, and of the shares and the n-gram score with the bias last; ``weights`` is None if
    the labels were all alike."""

    grams: np.ndarray
    weights: np.ndarray | None


def shares(raw: np.ndarray, offs: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Shares of kinds of characters, of repeated words and lines, and mean lengths: rows x N_SHARES."""
    base = base_counts(raw, offs, words, h)
    starts, ends, first = words
    n = np.maximum(1, base["n_words"])
    chars = np.maximum(1, base["word_chars"])
    out = [sums_by_row(k[raw], offs) / chars for k in CLASSES]
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = 0
    lines = np.maximum(1, sums_by_row((raw == 10).astype(np.int64), offs) + 1)
    out += [base["n_repeat_words"] / n, sums_by_row(same, first) / n, base["n_dup_lines"] / lines, np.minimum(1, base["word_chars"] / n / 20), np.log1p(base["n_words"]) / 10]
    return np.stack(out, 1)


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, y, n, idx, share, shares) of labelled documents: their sparse n-grams and their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, offs_all = text_block(batch.column("text"))
            for lo, hi in slices(offs_all):
                raw, offs = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                words = word_spans(raw, offs)
                h = span_hashes(raw, *words[:2])
                idx, share = sparse(raw, offs, words[2], h)
                cols = [batch.column("doc_id")[lo:hi], batch.column("y")[lo:hi], pa.array([len(x) for x in idx], pa.int64()), pa.array(idx, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32())), pa.array(list(shares(raw, offs, words, h)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "n", "idx", "share", "shares"])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, n long, idx array<int>, share array<float>, shares array<double>")


def with_evidence(docs: DataFrame, model: Evidence) -> DataFrame:
    """(doc_id, host, path, z): the log odds of good quality by the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw_all, offs_all = text_block(batch.column("text"))
            for lo, hi in slices(offs_all):
                raw, offs = raw_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                words = word_spans(raw, offs)
                h = span_hashes(raw, *words[:2])
                if own.weights is None:
                    z = np.full(hi - lo, 30.0)
                else:
                    x = np.column_stack([shares(raw, offs, words, h), dense(own.grams, 0.0, raw, offs, words[2], h)])
                    z = np.clip(x @ own.weights[:-1] + own.weights[-1], -30, 30)
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in ("doc_id", "host", "path")], pa.array(z)], ["doc_id", "host", "path", "z"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, z double")


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = 4000, most_entries: int = 1 << 23) -> Evidence:
    """The n-grams' weights and, over their score and the shares, a calibrated regression, from at most ``most`` labelled
    documents whose sparse features have ``most_entries`` entries in all.

    Two n-gram models are fitted on the two halves of the sample, and the regression sees each document's score by the
    model of the other half. The n-gram weights are the mean of the two.
    """
    ship(docs.sparkSession)
    rows = bounded(materialise(with_features(labelled(docs, labels, most)), "quality-features"), most_entries).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        return Evidence(np.zeros(1 << BITS, np.float32), None)
    dealt = mix(rows.column("doc_id").to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1))
    half, held = (dealt >> np.uint64(32)) % np.uint64(2) == 0, dealt % np.uint64(5) == 0
    counted = np.array(rows.column("shares").combine_chunks().flatten()).reshape(len(y), N_SHARES)
    lists, parts = rows.column("idx").combine_chunks(), rows.column("share").combine_chunks()
    del rows  # the features are held once from here on
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    idx, share = lists.flatten().to_numpy(), parts.flatten().to_numpy()
    grams, score = np.zeros(1 << BITS), np.zeros(len(y))
    for own in (half, ~half):
        if len(set(y[own])) == 2:
            mine = own[row]
            w, _ = descend(idx[mine], share[mine], (np.cumsum(own) - 1).astype(np.int32)[row[mine]], y[own], 60)
            grams += w / 2
            score[~own] = stretch_sums(w.astype(np.float32)[idx] * share, row, len(y))[~own]
    x = np.column_stack([counted, score])
    if len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    mean, std = x.mean(0), x.std(0) + 1e-6
    w = regression((x[~held] - mean) / std, y[~held])
    weights, bias = w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()
    slope, shift = platt(x[held] @ weights + bias, y[held]) if held.any() else (1.0, 0.0)
    return Evidence(grams.astype(np.float32), np.append(slope * weights, slope * bias + shift))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(rates: DataFrame) -> float:
    """Prior weight k of a beta distribution, by moments, from (n, total, prior): the rates' scatter about their
    priors beyond what sampling makes. Few or like sites give a strong prior."""
    excess = F.sum(F.pow(F.col("total") - F.col("n") * F.col("prior"), 2) - F.col("n") * F.col("prior") * (1 - F.col("prior")))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * F.col("prior") * (1 - F.col("prior")))
    row = rates.agg(excess.alias("e"), pairs.alias("p")).first()
    rho = row["e"] / row["p"] if row["p"] else 0.0  # correlation within a site: 1 / (k + 1)
    return float(min(1e4, max(1.0, 1 / rho - 1))) if rho > 0 else 1e4


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, most: int = 4000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, p_document, p_host, p_path, posterior, kept) for each document.

    ``host`` and ``path`` default to the source and, within it, the language. Null sites are sites of their
    own; null and empty texts are judged by their shares and score, which are all 0. A posterior of just ``threshold`` is
    kept. Without both kinds of labels every document is kept. Other columns of ``docs`` are left out.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    plain = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    scored = materialise(with_evidence(plain, fit(docs, labels, most)).withColumn("p", 1 / (1 + F.exp(-F.col("z")))), "evidence")
    site = F.xxhash64(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")), F.coalesce(F.concat(F.lit("p"), "path"), F.lit("n")))
    top = F.xxhash64(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")))
    scored = scored.withColumns({"site": site, "top": top})
    paths = materialise(scored.groupBy("top", "site").agg(F.count("*").alias("n"), F.sum("p").alias("total")), "paths")
    overall = paths.agg((F.sum("total") / F.sum("n")).alias("m")).first()["m"]
    if overall is None:
        overall = 0.5
    hosts = paths.groupBy("top").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    k_host = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total"), F.lit(overall).alias("prior")))
    rated = paths.join(hosts, "top")
    rated = rated.withColumn("prior", (F.col("host_total") + k_host * overall) / (F.col("host_n") + k_host))
    k_path = strength(rated)
    rated = materialise(rated.select("site", "n", "total", "host_n", "host_total"), "sites")
    # a site's rate without the document itself, at each level
    joined = scored.join(rated, "site")
    p_host = (F.col("host_total") - F.col("p") + k_host * overall) / (F.col("host_n") - 1 + k_host)
    p_path = (F.col("total") - F.col("p") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)
    shift = logit(F.col("p_path")) - logit(F.lit(overall))
    joined = joined.withColumn("p_host", p_host).withColumn("p_path", p_path).withColumn("posterior", 1 / (1 + F.exp(-(F.col("z") + shift))))
    return joined.select("doc_id", "host", "path", F.col("p").alias("p_document"), "p_host", "p_path", "posterior", (F.col("posterior") >= threshold).alias("kept"))
