"""Splits, shuffles, shards, padded batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import with_position


def hashed(seed: int | str, *keys: Column) -> Column:
    """A hash that any SQL engine has: md5 of seed and keys, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def positional_split(df: DataFrame, order: list[str], val_size: int, subset: int = 0) -> DataFrame:
    """Adds idx and split: the first rows are ``train``, the last ``min(val_size, int(0.2 n))`` are ``val``."""
    placed = with_position(df, order)
    n = df.count()
    n = min(n, subset) if subset else n
    val = min(val_size, int(0.2 * n))
    train = int(n * ((n - val) / n)) if n else 0
    return placed.filter(F.col("idx") < n).withColumn("split", F.when(F.col("idx") < train, "train").otherwise("val"))


def block_shuffle(df: DataFrame, order: list[str], buffer: int, seed: int = 0) -> DataFrame:
    """Adds block and place: rows change places within blocks of ``buffer`` consecutive rows only."""
    placed = with_position(df, order).withColumn("block", F.floor(F.col("idx") / buffer))
    w = Window.partitionBy("block").orderBy(hashed(seed, F.col("idx")), "idx")
    return placed.withColumn("place", (F.col("block") * buffer + F.row_number().over(w) - 1).cast("long"))


def shard(df: DataFrame, order: list[str], n: int, mode: str = "round_robin") -> DataFrame:
    """Adds idx and shard: by turns, or contiguous with the remainder on the first shards."""
    placed = with_position(df, order)
    if mode == "round_robin":
        return placed.withColumn("shard", (F.col("idx") % n).cast("int"))
    size, extra = divmod(df.count(), n)
    edge = (size + 1) * extra
    i = F.col("idx")
    spread = F.when(i < edge, F.floor(i / (size + 1))).otherwise(F.lit(extra) + F.floor((i - edge) / max(1, size)))
    return placed.withColumn("shard", spread.cast("int"))


def pad_batches(df: DataFrame, ids: str, batch: int, cap: int, pad: int = 0) -> DataFrame:
    """Batches of ``batch`` consecutive rows (by idx), padded to the longest of the batch or ``cap``; adds mask."""
    grouped = df.withColumn("batch", F.floor(F.col("idx") / batch))
    width = F.least(F.max(F.size(ids)).over(Window.partitionBy("batch")), F.lit(cap))
    wide = grouped.withColumn("width", width)
    padded = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.col("width"))), F.lit(1), F.col("width"))
    mask = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: (i <= F.size(ids)).cast("int"))
    return wide.withColumn("mask", F.when(F.col("width") > 0, mask).otherwise(F.array().cast("array<int>"))).withColumn(ids, padded)


def tail_rows(df: DataFrame, order: list[str], n: int, column: str) -> DataFrame:
    """The last ``n`` rows, then without those whose column is null."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).filter(F.col(column).isNotNull())


def sample_to(df: DataFrame, target: int, key: str, seed: int = 0) -> DataFrame:
    """Each row with probability target / total, by a hash of its key: the same rows in every run."""
    total = df.count()
    rate = min(1.0, target / total) if total else 0.0
    return df.filter(F.conv(F.substring(hashed(seed, F.col(key)), 1, 8), 16, 10).cast("double") < rate * 2.0**32)


def sample_files(listing: DataFrame, n: int, seed: int = 0, name: str = "name") -> DataFrame:
    return listing.orderBy(hashed(seed, F.col(name)), name).limit(n)


def distinct_until(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first ``n`` different strings in order of their first row."""
    return df.groupBy(column).agg(F.min(order).alias("first_at")).orderBy("first_at").limit(n)


def draw(templates: DataFrame, order: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, idx, ...): ``n`` seeded draws with replacement."""
    placed = with_position(templates, [order])
    total = templates.count()
    draws = templates.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("idx", (F.conv(F.substring(hashed(seed, F.col("draw")), 1, 8), 16, 10).cast("long") % max(1, total)).cast("long"))
    return draws.join(placed, "idx")


def augment(df: DataFrame, key: str, text: str, variants: str, factor: int, include_original: bool = True) -> DataFrame:
    """(key, variant_no, text): the original first, then up to ``factor`` variants, repeats of a string left out."""
    some = F.slice(F.coalesce(variants, F.array().cast("array<string>")), 1, factor)
    every = F.array_distinct(F.concat(F.array(F.col(text)), some)) if include_original else F.array_distinct(some)
    return df.select(key, F.posexplode(every).alias("variant_no", text))


def curriculum(df: DataFrame, key: str, ids: str, total: int, low: int, high: int) -> DataFrame:
    """(epoch, key, ids, is_cut): each epoch's sequences, cut to a cap that rises from ``low`` to ``high``."""
    caps = df.sparkSession.range(total).select(F.col("id").cast("int").alias("epoch"))
    rise = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("epoch") / F.lit(float(total))))
    caps = caps.withColumn("cap", (low + (high - low) * rise).cast("int"))
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).join(F.broadcast(caps), "epoch")  # ``total`` rows
    return out.select("epoch", key, F.slice(F.col(ids), F.lit(1), F.col("cap")).alias(ids), (F.size(ids) > F.col("cap")).alias("is_cut"))
