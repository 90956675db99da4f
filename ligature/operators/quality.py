"""Quality of generated strings: novelty, similarity, lengths, rewards, audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import cap
from .scan import ranged, stored


def novelty(generated: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """(total, novel, novelty): strings of ``generated`` that ``known`` doesn't have."""
    marked = generated.join(known.select(F.col(column), F.lit(1).alias("_seen")).distinct(), column, "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("_seen").isNull()).alias("novel")).withColumn("novelty", F.coalesce(F.try_divide("novel", "total"), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def pairwise_jaccard(df: DataFrame, order: str, features: str, n: int = 100) -> DataFrame:
    """(pairs, mean_similarity) of the feature sets of the first ``n`` rows; the cap is the operator's own."""
    first = cap(df.select(F.col(order).alias("i"), F.array_distinct(features).alias("f")).filter(F.size("f") > 0), ["i"], n)
    pairs = first.alias("a").join(first.alias("b"), F.col("a.i") < F.col("b.i"))
    return pairs.agg(F.count("*").alias("pairs"), F.avg(jaccard(F.col("a.f"), F.col("b.f"))).alias("mean_similarity"))


def diversity(df: DataFrame, order: str, features: str, n: int = 100) -> DataFrame:
    return pairwise_jaccard(df, order, features, n).select("pairs", (1 - F.col("mean_similarity")).alias("diversity"))


def set_classes(df: DataFrame, features: str) -> DataFrame:
    """(f, n): the different feature sets and how many rows have each; empty and null sets are left out."""
    return df.select(F.array_sort(F.array_distinct(features)).alias("f")).filter(F.size("f") > 0).groupBy("f").agg(F.count("*").alias("n"))


def diversity_all(df: DataFrame, features: str, most_pairs: int = 100_000_000) -> DataFrame:
    """(pairs, diversity) over all pairs of rows, exactly. Equal sets count as one class with a weight, and classes meet
    where an inverted index says that they share a feature; other pairs have similarity 0 and are never made.

    The work is the square of the classes that share a feature. Above ``most_pairs`` of these it is an error, that names
    diversity_estimate(), which is linear.
    """
    classes = stored(set_classes(df, features)).withColumn("c", F.monotonically_increasing_id())
    each = classes.select("c", "n", F.size("f").alias("s"), F.explode("f").alias("g"))
    met = each.groupBy("g").agg(F.count("*").alias("k")).agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0] or 0
    if met > most_pairs:
        raise ValueError(f"{met:.0f} pairs of different sets share a feature, more than {most_pairs}: use diversity_estimate")
    a, b = each.alias("a"), each.alias("b")
    shared = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.c") < F.col("b.c"))).groupBy("a.c", "b.c").agg(F.count("*").alias("both"), F.first(F.col("a.s") + F.col("b.s")).alias("s"), F.first(F.col("a.n").cast("double") * F.col("b.n")).alias("w"))
    between = shared.agg(F.coalesce(F.sum(F.col("w") * F.col("both") / (F.col("s") - F.col("both"))), F.lit(0.0)).alias("between"))
    n = F.col("n").cast("double")
    totals = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias("within"))
    pairs = (F.col("rows") * (F.col("rows") - 1) / 2).cast("long")
    return totals.crossJoin(F.broadcast(between)).select(pairs.alias("pairs"), (1 - F.try_divide(F.col("within") + F.col("between"), pairs)).alias("diversity"))  # one row each


def diversity_estimate(df: DataFrame, features: str, hashes: int = 64, hash_of: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """(pairs, diversity, error) over all pairs of rows by MinHash, in time linear in the rows.

    Two sets have the same least hash with a probability that is their similarity, so the share of pairs in equal buckets is an
    unbiased estimate of the mean for each of the ``hashes`` functions; ``error`` is the standard error of their mean. Only
    buckets are counted, so a hot one is a number and no pair is made.
    """
    classes = set_classes(df, features)
    least = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda k: F.array_min(F.transform("f", lambda g: hash_of(k, g))))
    buckets = classes.select("n", F.posexplode(least).alias("k", "m")).groupBy("k", "m").agg(F.sum("n").cast("double").alias("w"))
    each = buckets.groupBy("k").agg(F.sum("w").alias("rows"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("equal"))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    share = F.try_divide(F.col("equal"), pairs)
    return each.agg(F.first(pairs).cast("long").alias("pairs"), (1 - F.avg(share)).alias("diversity"), (F.stddev_samp(share) / F.sqrt(F.lit(hashes))).alias("error"))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Runs of ``n`` tokens, each joined to one string; the whole of a shorter list."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) < n, F.array(F.array_join(tokens, " "))).otherwise(grams)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_summary(df: DataFrame, vector: str, batch: str, key: str) -> DataFrame:
    """(batch, pairs, mean, std, max, min) of the cosines between different rows of each batch. Rows meet within
    their batch only; a batch is as small as a training batch."""
    unit = df.select(batch, F.col(key).alias("k"), F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))
    a, b = unit.alias("a"), unit.alias("b")
    pairs = a.join(b, (F.col(f"a.{batch}") == F.col(f"b.{batch}")) & (F.col("a.k") != F.col("b.k")))
    cos = dot(F.col("a.v"), F.col("b.v")) / (F.greatest(F.col("a.norm"), F.lit(1e-12)) * F.greatest(F.col("b.norm"), F.lit(1e-12)))
    each = pairs.select(F.col(f"a.{batch}").alias(batch), cos.alias("c"))
    return each.groupBy(batch).agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"), F.stddev_samp("c").alias("std"), F.max("c").alias("max"), F.min("c").alias("min"))


def cosine_moments(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """(pairs, mean, std) of the cosines between all different rows, without a pair: from the sum of the unit vectors and
    their Gram matrix, of which each task hands on one. Vectors of another length, and those with nulls, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram, total, fourth = 0, np.zeros((dims, dims)), np.zeros(dims), 0.0
        for batch in batches:
            rows = np.asarray(batch.column("v").flatten(), np.float64).reshape(-1, dims)
            unit = rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-12)[:, None]
            n, gram, total = n + len(unit), gram + unit.T @ unit, total + unit.sum(axis=0)
            fourth += float(((unit * unit).sum(axis=1) ** 2).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "x": [np.concatenate([gram.ravel(), total, [np.trace(gram), fourth]]).tolist()]})

    whole = df.select(F.col(vector).alias("v")).filter((F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull()))
    parts = whole.mapInArrow(run, "n long, x array<double>")
    sums = parts.select("n", F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    square, i, x = dims * dims, F.col("i"), F.col("x")
    pick = lambda a, b, value: F.coalesce(F.sum(F.when((i >= a) & (i < b), value)), F.lit(0.0))
    row = sums.agg(F.max("n").alias("n"), pick(0, square, x * x).alias("gg"), pick(square, square + dims, x * x).alias("ss"), pick(square + dims, square + dims + 1, x).alias("own"), pick(square + dims + 1, square + dims + 2, x).alias("own2"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = F.try_divide(F.col("ss") - F.col("own"), pairs)
    spread = F.try_divide(F.col("gg") - F.col("own2") - pairs * mean * mean, pairs - 1)
    return row.select(F.coalesce(pairs, F.lit(0)).cast("long").alias("pairs"), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(n, values array<double>): the quantiles of a column at ``shares``, interpolated between neighbours; nulls are left out.

    Different values are counted, dealt to ranges and numbered by running counts, and the two neighbours of each rank are
    picked, so no task holds all values. None gives null values.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    rows = ranged(counts, ["v"])
    parts = rows.groupBy("_part").agg(F.sum("c").alias("_c"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))  # a row a part
    inside = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("c").over(inside)
    placed = rows.join(F.broadcast(offsets), "_part").select("v", upto.alias("to"), (upto - F.col("c")).alias("from"))
    ranked = placed.crossJoin(F.broadcast(parts.agg(F.sum("_c").alias("n"))))  # one row
    at = lambda rank: F.max(F.when((F.col("from") <= rank) & (rank < F.col("to")), F.col("v")))
    values = []
    for q in shares:
        rank = (F.col("n") - 1) * F.lit(q)
        low, part = at(F.floor(rank)), F.max(rank - F.floor(rank))
        values.append(low + (at(F.ceil(rank)) - low) * part)
    return ranked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.array(*values).alias("values"))


def masked_mean(df: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """(key, dim, mean): mean of each component over the positions that the mask keeps."""
    return df.filter(mask).select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def length_stats(df: DataFrame, order: str, size: Column, n: int = 0, approximate: bool = False) -> DataFrame:
    """Mean, median, min, max, population deviation and 95th percentile of the first ``n`` sizes (0: all)."""
    some = cap(df.select(F.col(order).alias("_at"), size.alias("s")), ["_at"], n)
    at = (lambda q: F.percentile_approx("s", q, 10000).cast("double")) if approximate else (lambda q: F.percentile("s", q))
    return some.agg(F.count("*").alias("n"), F.avg("s").alias("mean"), at(0.5).alias("median"), F.min("s").cast("long").alias("min"), F.max("s").cast("long").alias("max"), F.stddev_pop("s").alias("std"), at(0.95).alias("p95"))


def diversity_probe(df: DataFrame, order: str, tokens: str, n: int = 1000) -> DataFrame:
    """(n, unique, mean_length) of the first ``n`` token lists."""
    some = cap(df.select(F.col(order).alias("_at"), F.col(tokens).alias("t")), ["_at"], n)
    return some.agg(F.count("*").alias("n"), F.countDistinct(F.array_join("t", " ")).alias("unique"), F.avg(F.size("t")).alias("mean_length"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def generation_quality(df: DataFrame, text: str, valid: Column, qed: Column) -> DataFrame:
    """Validity, uniqueness among valid strings and their mean qed; 0 where there is nothing to divide by."""
    out = df.agg(
        F.count("*").alias("total_generated"),
        F.count_if(valid).alias("num_valid"),
        F.countDistinct(F.when(valid, F.col(text))).alias("num_unique"),
        F.coalesce(F.avg(F.when(valid, qed)), F.lit(0.0)).alias("avg_qed"),
    )
    return out.withColumns({"validity": _ratio(F.col("num_valid"), F.col("total_generated")), "uniqueness": _ratio(F.col("num_unique"), F.col("num_valid"))})


def generation_report(df: DataFrame, text: str, valid: Column) -> DataFrame:
    """generation_quality with the properties of valid strings: mw, logp, qed, is_drug_like."""
    base = generation_quality(df, text, valid, F.col("qed"))
    props = df.filter(valid).agg(
        F.avg("mw").alias("avg_molecular_weight"), F.avg("logp").alias("avg_logp"), F.min("qed").alias("min_qed"), F.max("qed").alias("max_qed"), F.avg(F.col("is_drug_like").cast("double")).alias("drug_like_share")
    )
    return base.crossJoin(F.broadcast(props))  # one row each


def reward_means(df: DataFrame, batch: Column) -> DataFrame:
    return df.groupBy(batch.alias("batch")).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("reward", "validity", "qed", "sa")])


def augmentation_audit(df: DataFrame, original: str, original_key: str, valid: Column, key: str) -> DataFrame:
    """(original, all_valid, all_equivalent, num_unique) over each original's variants."""
    same = valid & (F.col(key) == F.col(original_key))
    return df.groupBy(original).agg(F.bool_and(valid).alias("all_valid"), F.bool_and(same).alias("all_equivalent"), F.countDistinct(F.when(valid, F.col(key))).alias("num_unique"))


def round_trip_rate(df: DataFrame, key_in: Column, key_out: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg(key_in.eqNullSafe(key_out).cast("double")), F.lit(0.0)).alias("rate"))


def row_count(df: DataFrame, column: str) -> DataFrame:
    """All rows, and those that aren't blank."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.trim(column) != "").alias("n_non_blank"))
