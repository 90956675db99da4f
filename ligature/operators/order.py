"""Row positions at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .scan import positions

#: Ranges of the rows that share a value of the first column.
SUB = 16


def with_position(df: DataFrame, order: list[str], name: str = "idx", parts: int | None = None) -> DataFrame:
    """Adds the 0-based position in the order of ``order``, without a global window.

    Where the first two columns are numbers, and the first is seldom null, rows are dealt to ranges of the first column between approximate quantiles (``parts`` numbers, fixed before
    use, so every pass deals alike), counted by range, and numbered within their range from the count of those
    before. A quantile is a range of its own, and is dealt again by the second column, so a value
    that many rows share doesn't gather in one task. Only the ranges' counts, a row each, pass through one window.
    Other keys go by Spark's ranges of the whole key, which are stored (scan.positions).
    """
    if not all(isinstance(df.schema[c].dataType, NumericType) for c in order[:2]):
        return positions(df, list(order), name)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order[0]).cast("double")
    edges, unknown, n = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5]), F.count_if(key.isNull()), F.count("*")).first()
    if unknown * parts > n:
        return positions(df, list(order), name)
    edges = edges or []
    known = F.array(*map(F.lit, sorted(set(edges)))).cast("array<double>")
    dealt = F.size(F.filter(known, lambda e: e < key)) * 2 + F.array_contains(known, F.coalesce(key, F.lit(float("nan")))).cast("int")
    ranged = df.withColumn("_part", (dealt * SUB).cast("long"))
    if len(order) > 1:
        second = F.col(order[1]).cast("double")
        cuts = ranged.filter(f"_part % {2 * SUB} = {SUB}").groupBy("_part").agg(F.percentile_approx(second, [i / SUB for i in range(1, SUB)]).alias("e")).collect()  # ``parts`` rows of SUB numbers
        if cuts:
            finer = F.create_map(*[F.lit(x) for r in cuts for x in (r["_part"], [float(v) for v in r["e"] or []])])
            ranged = ranged.withColumn("_part", F.col("_part") + F.coalesce(F.size(F.filter(F.try_element_at(finer, F.col("_part")), lambda e: e < second)), F.lit(0)))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(offsets), "_part")  # ``parts`` rows, and SUB for each value that is a quantile
    return joined.withColumn(name, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_offset")


#: Parts that are few on any cluster, and the share of the cores below which more parts are few too.
FEW_PARTS, FEW_SHARE = 64, 0.1


def too_few(parts: int, cores: int) -> bool:
    """Whether moving all rows is worth the cores that would stand idle: never for a scan that keeps a tenth of a large
    cluster busy, whose parts ``spark.sql.files.maxPartitionBytes`` makes smaller without moving a row."""
    return parts < cores and (parts <= FEW_PARTS or parts < FEW_SHARE * cores)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it comes in too few parts (one row group or one gzip file, say), for work row by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if too_few(df.rdd.getNumPartitions(), cores) else df


def cap(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order; 0 takes all."""
    return df.orderBy(*order).limit(n) if n else df


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; null keys go. Partial minima, so a frequent key gathers nowhere."""
    rest = [c for c in df.columns if c != key]
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return least.select(key, "_row.*")
