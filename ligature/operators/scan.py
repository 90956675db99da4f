"""Ordered rows at scale: positions over keys of any type, and windows over runs that no task can hold.

Rows are dealt to Spark's ranges of the whole key and stored, so that every later pass sees the same parts. Numbers, minima
and the last rows of each part then reach the next one as small tables: a part has one end, so no more runs than parts
cross one, and what is handed on is bounded by the parts, whatever the runs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a run that one task may hold; longer runs go in segments.
LONGEST = 1_000_000
#: Bits of the place within a part in Spark's increasing ids.
_PLACE = 33


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local master has none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows in parts of Spark's ranges over ``order``, sorted, with ``_part`` and the increasing ``_at``; stored."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stored(dealt.withColumn("_part", F.shiftright("_at", _PLACE)))


def positions(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Adds the 0-based position in ``order``, columns of any type, nulls where Spark sorts them. Rows that are equal in all
    of ``order`` lie in one part; further columns in it tell them apart."""
    rows = ranged(df, order)
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row a part
    place = F.col("_at") - F.shiftleft("_part", _PLACE)
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + place).alias(name))


def by_length(df: DataFrame, run: str, longest: int = LONGEST) -> tuple[DataFrame, DataFrame | None]:
    """Rows of runs of at most ``longest`` rows, and those of longer ones if there are any."""
    long = df.groupBy(F.col(run).alias("_long")).agg(F.count("*").alias("_n")).filter(F.col("_n") > longest).select("_long")
    if long.isEmpty():
        return df, None
    long = stored(long)
    same = F.col(run).eqNullSafe(F.col("_long"))
    long = F.broadcast(long)  # one for each ``longest`` rows at most
    return df.join(long, same, "left_anti"), df.join(long, same, "left_semi")


def segments(df: DataFrame, run: str, order: list[str | Column], halo: int = 0, least: str | None = None) -> DataFrame:
    """Rows of runs cut into segments: adds ``_n`` (1-based number in the run), ``_seg``, ``_own`` and ``_best``.

    Windows over (run, _seg) by _n see, besides a segment's own rows, copies of the ``halo`` rows before it (_own false), and
    before those one row (_n 0, else null) if others came earlier: its ``_best`` is the least ``least`` so far with the number
    of the first row that had it. ``_best`` of other own rows is (their own value, their number), null for NaN and null.
    """
    rows = ranged(df, [run, *order])
    keys = [run, "_part"]
    value = F.when(~F.isnan(least), F.col(least)) if least else F.lit(None).cast("double")
    best = F.min(F.when(value.isNotNull(), F.struct(value.alias("value"), F.col("_at").alias("n"))))
    parts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"), best.alias("_least"))
    # runs in more than one part: each but the last part has one at most, so there are two rows a part at most
    crossing = parts.withColumn("_k", F.count("*").over(Window.partitionBy(run))).filter("_k > 1")
    before = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = crossing.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    numbered = F.when(F.col("_least").isNotNull(), F.struct(F.col("_least.value").alias("value"), (F.col("_least.n") - F.col("_first") + F.col("_offset") + 1).alias("n")))
    crossing = stored(crossing.withColumn("_carry", F.min(numbered).over(before)).select(F.col(run).alias("_run"), F.col("_part").alias("_p"), "_rows", "_first", "_offset", "_carry"))
    at = F.col(run).eqNullSafe(F.col("_run")) & (F.col("_part") == F.col("_p"))
    inside = Window.partitionBy(*keys).orderBy("_at")
    own = rows.join(F.broadcast(crossing), at, "left").withColumn("_n", F.coalesce(F.col("_at") - F.col("_first") + F.col("_offset") + 1, F.row_number().over(inside).cast("long")))
    mine = F.when(value.isNotNull(), F.struct(value.alias("value"), F.col("_n").alias("n")))
    own = own.select(*df.columns, F.col("_n"), F.col("_part").alias("_seg"), F.lit(True).alias("_own"), mine.alias("_best"))
    later = crossing.filter("_offset > 0")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != run else F.col("_run").cast(f.dataType).alias(run) for f in df.schema]
    carried = later.select(*blank, F.lit(0).cast("long").alias("_n"), F.col("_p").alias("_seg"), F.lit(False).alias("_own"), F.col("_carry").alias("_best"))
    out = own.unionByName(carried)
    if halo:
        # the last rows of each part that a run leaves, to the parts that begin at most ``halo`` rows later
        ends = rows.join(F.broadcast(crossing), at).withColumn("_n", F.col("_at") - F.col("_first") + F.col("_offset") + 1)
        ends = ends.filter(F.col("_n") > F.col("_offset") + F.col("_rows") - halo).withColumn("_b", F.floor(F.col("_n") / halo)).drop("_run", "_p", "_carry", "_offset", "_rows", "_first")
        first = F.col("_offset") + 1
        wanted = later.select("_run", F.col("_p").alias("_seg"), first.alias("_start"), F.explode(F.sequence(F.floor((first - halo) / halo), F.floor((first - 1) / halo))).alias("_bucket"))
        near = F.col(run).eqNullSafe(F.col("_run")) & (F.col("_b") == F.col("_bucket")) & (F.col("_n") < F.col("_start")) & (F.col("_n") >= F.col("_start") - halo)
        copies = ends.join(F.broadcast(wanted), near)  # a few rows a part
        out = out.unionByName(copies.select(*df.columns, "_n", "_seg", F.lit(False).alias("_own"), F.lit(None).cast(own.schema["_best"].dataType).alias("_best")))
    return out
