"""Language identification by unigrams over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over
all ways to cut it into pieces, by the forward algorithm, whatever its length; a text's is the product over its words. The piece
probabilities are learned by expectation maximisation: forward and backward sums give the expected counts of
the pieces in each language's words.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, ship

START = "▁"
BLOCK = 256  # places of a word whose pieces are looked up at once
CELLS = 1 << 17  # words times places of a lattice that are held at once, one word at least
FLOOR = 1e-9  # of a character that is no piece
SCALE = 16.0  # for each character: keeps the sums near one, as does a division after each RESCALE places
RESCALE = 8
MOST_WORDS = 300_000  # that a task remembers
RUNS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece model, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return sorted({p.lower() for p in map(model.id_to_piece, ids)})


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Pieces:
    """Finds the pieces that start at each place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.by_length = {}
        lengths = np.array([len(p) for p in pieces])
        self.longest = int(lengths.max(initial=1))
        for n in sorted(set(lengths.tolist())):
            own = np.flatnonzero(lengths == n)
            h = np.zeros(len(own), np.uint64)
            flat = codes("".join(pieces[i] for i in own)).reshape(len(own), n)
            for k in range(n):
                h = self.step(h, flat[:, k])
            order = np.argsort(h)
            self.by_length[n] = (h[order], own[order])

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1))

    def lattice(self, words: list[str], lo: int, hi: int) -> dict[int, np.ndarray]:
        """For each piece length a matrix (words, start - lo) of the pieces that start at the places lo..hi - 1: ids,
        ``size`` where there is none and ``size + 1`` for a character that is no piece. Lengths without any are left out."""
        parts = [w[lo : hi + self.longest - 1] for w in words]
        lengths = np.array([len(w) for w in parts])
        wide = int(lengths.max(initial=0))
        grid = np.zeros((len(words), wide), np.uint64)
        grid[np.arange(wide) < lengths[:, None]] = codes("".join(parts))
        found, h = {}, np.zeros((len(words), wide), np.uint64)
        for n in range(1, min(wide, self.longest) + 1):
            h = self.step(h[:, : wide - n + 1], grid[:, n - 1 :])
            keys, ids = self.by_length.get(n, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            own = h[:, : hi - lo]
            got = np.full(own.shape, self.size, np.int32)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                same = keys[at] == own
                got[same] = ids[at][same]
            if n == 1:
                got[got == self.size] = self.size + 1
            got[np.arange(own.shape[1]) > (lengths - n)[:, None]] = self.size
            if n == 1 or (got != self.size).any():
                found[n] = got
        return found


def table_of(probabilities: np.ndarray) -> np.ndarray:
    """Rows for every piece, for no piece (0) and for other characters (FLOOR); a column a language."""
    return np.vstack([probabilities, np.zeros(probabilities.shape[1]), np.full(probabilities.shape[1], FLOOR)])


def forward(words: list[str], pieces: Pieces, probs: np.ndarray, langs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Log of the sum over all segmentations of each word: (words, languages).

    The lattice comes in blocks of places; the sums of the prefixes that end at the next places are carried over their
    edges, so neither a long word nor a long piece is cut. With ``langs``, a number for each word, only that language's
    sums are made, and those of all prefixes are returned too: (words, places + 1), and the logs of their scales.
    """
    lengths = np.array([len(w) for w in words])
    wide, shape = int(lengths.max(initial=0)), (len(words), 1 if langs is not None else probs.shape[1])
    ahead = deque(np.zeros(shape) for _ in range(pieces.longest + 1))  # of the prefixes that end here, one on, two on, ...
    ahead[0] += 1.0
    scale, out = np.zeros(shape), np.zeros(shape)
    kept = (np.zeros((len(words), wide + 1)), np.zeros((len(words), wide + 1))) if langs is not None else (None, None)
    for lo in range(0, wide + 1, BLOCK):
        hi = min(lo + BLOCK, wide)
        found = pieces.lattice(words, lo, hi) if lo < hi else {}
        for start in range(lo, min(lo + BLOCK, wide + 1)):
            now = ahead.popleft()
            ahead.append(np.zeros(shape))
            ends = lengths == start
            if ends.any():
                out[ends] = np.log(now[ends]) + scale[ends]
            if langs is not None:
                kept[0][:, start], kept[1][:, start] = now[:, 0], scale[:, 0]
            for n, ids in found.items():
                at = ids[:, start - lo] if start - lo < ids.shape[1] else None
                if at is not None:
                    ahead[n - 1] += now * (probs[at] if langs is None else probs[at, langs][:, None]) * SCALE**n
            if start % RESCALE == RESCALE - 1:
                most = np.maximum.reduce(ahead)
                most[most <= 0] = 1.0
                for x in ahead:
                    x /= most
                scale = scale + np.log(most)
    return out - np.log(SCALE) * lengths[:, None], *kept


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of ``words`` by length, so many at once that words times places stay within CELLS."""
    order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])), np.int64)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(words[order[to]]) + 1) <= CELLS:
            to += 1
        yield order[at:to]
        at = to


def word_scores(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    for own in batches_of(words):
        out[own] = forward([START + words[i] for i in own], pieces, probs)[0]
    return out


def expected(words: list[str], weights: np.ndarray, langs: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected counts (pieces, languages) of ``weights`` words, each in its language, by forward and backward sums."""
    counts = np.zeros(probs.shape)
    for own in batches_of(words):
        marked, lang = [START + words[i] for i in own], langs[own]
        lengths = np.array([len(w) for w in marked])
        total, sums, scales = forward(marked, pieces, probs, lang)
        total = total[:, 0] + np.log(SCALE) * lengths
        wide = int(lengths.max(initial=0))
        behind = deque(np.zeros(len(own)) for _ in range(pieces.longest + 1))  # of the suffixes from here, one on, ...
        scale = np.zeros(len(own))
        for lo in range((wide - 1) // BLOCK * BLOCK, -1, -BLOCK):
            hi = min(lo + BLOCK, wide)
            found = pieces.lattice(marked, lo, hi)
            for start in range(hi - 1, lo - 1, -1):
                ends = lengths == start + 1
                scale[ends] = 0.0
                behind[0][ends] = 1.0
                # mass of an edge: forward sum at its start, its piece, backward sum at its end, over the word's sum
                front = np.exp(np.minimum(scales[:, start] + scale - total, 700.0)) * sums[:, start] * weights[own]
                new = np.zeros(len(own))
                for n, ids in found.items():
                    if start - lo >= ids.shape[1]:
                        continue
                    edge = probs[ids[:, start - lo], lang] * SCALE**n * behind[n - 1]
                    new += edge
                    some = np.flatnonzero(edge)
                    np.add.at(counts, (ids[some, start - lo], lang[some]), front[some] * edge[some])
                behind.pop()
                behind.appendleft(new)
                if start % RESCALE == 0:
                    most = np.maximum.reduce(behind)
                    most[most <= 0] = 1.0
                    for x in behind:
                        x /= most
                    scale = scale + np.log(most)
    return counts


def letter_words(text: str) -> list[str]:
    return RUNS.findall(text.lower())


def learn(docs: DataFrame, path: str, most: int = 2000, rounds: int = 3) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and probabilities from (doc_id, text, lang): of each language at most ``most`` documents, those
    whose ids have the smallest hashes, with their whole texts. Counts of words are summed by Spark; what comes to the
    driver each round is bounded by pieces times languages."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.filter("lang is not null and text is not null")
    # hashes are even, so those below 2 * most / n hold the smallest ``most`` of n, and only so many rows meet in a task
    # the counts are a table of their own, so that Spark knows their size and filters before it shuffles
    counts = materialise(docs.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    below = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < F.lit(2.0 * most + 100) / F.col("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = materialise(docs.select("lang", "doc_id").join(counts, "lang").filter(below).withColumn("place", place).filter(F.col("place") <= most).select("lang", "doc_id"), "language-sample")
    taken = docs.join(some, ["lang", "doc_id"], "left_semi")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for w in letter_words(text.as_py() or ""):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    words = materialise(taken.select("lang", "text").mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    names = vocabulary(path)
    probs = np.full((len(names), len(langs)), 1.0 / max(1, len(names)))
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((langs, names, probs))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own_langs, own_names, own = sent.value
            finder, full = Pieces(own_names), table_of(own)
            total = np.zeros(full.shape)
            for batch in batches:
                number = np.array([own_langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                total += expected(batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float), number, finder, full)
            ids, lang = np.nonzero(total[: len(own_names)])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lang), pa.array(total[ids, lang])], ["piece", "lang", "mass"])

        sums = words.mapInArrow(step, "piece long, lang long, mass double").groupBy("piece", "lang").agg(F.sum("mass").alias("mass")).toArrow()
        counts = np.zeros(probs.shape)
        counts[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("mass").to_numpy()
        probs = (counts + 0.01) / (counts + 0.01).sum(0)
    return langs, names, probs


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) from the whole text alone: the likeliest language and its probability.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.
    Languages of equal probability go by name. Other columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # pieces x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, names, own = sent.value
        finder, full = Pieces(names), table_of(own)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = [letter_words(x.as_py() or "") if langs else [] for x in batch.column("text")[at : at + 512]]
                if len(known) > MOST_WORDS:
                    known, scores = {}, np.zeros((0, len(langs)))
                new = list({w for t in texts for w in t}.difference(known))
                if new:
                    scores = np.vstack([scores, word_scores(new, finder, full)])
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                pred, prob = [], []
                get = known.__getitem__
                for words in texts:
                    if not words or not any(c.isalpha() for w in words for c in w):
                        pred.append("und")
                        prob.append(0.0)
                        continue
                    z = scores[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
                    best = int(z.argmax())
                    pred.append(langs[best])
                    prob.append(float(1 / np.exp(z - z[best]).sum()))
                n = len(pred)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[at : at + n], pa.array(pred, pa.string()), pa.array(prob, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame, path: str, most: int = 2000) -> DataFrame:
    """Learn where crc32(doc_id) mod 3 is not 1, predict everywhere: (doc_id, held_out, lang_pred, score)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = learn(docs.filter(fold != 1), path, most)
    return predict(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
