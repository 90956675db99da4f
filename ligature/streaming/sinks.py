"""Sinks that may see a batch twice: strings that come once for ever, and the conversion ledger.

Both keep what they wrote as a table by batch number. A batch is judged by the batches before it and overwrites its own
part, so a replay, after a failure between the write and the commit, writes the same again. Streaming state is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.plugs import Convert, convert_with_ledger
from ..operators.scan import stored


def earlier(spark: SparkSession, path: str, schema: StructType, batch: int) -> DataFrame:
    """What batches before this one wrote; only their folders are read."""
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path).filter(F.col("batch") < batch).drop("batch")


def unseen(rows: DataFrame, column: str, path: str, batch: int) -> DataFrame:
    """Rows whose string no earlier batch wrote to ``path``, compared as strings.

    The table is cut to the batch's strings first, a semi join for which Spark broadcasts them or puts a Bloom filter of them
    before the table's shuffle, so of the table only what matches is moved.
    """
    seen = earlier(rows.sparkSession, path, rows.select(column).schema, batch)
    hits = seen.join(rows.select(column).distinct(), column, "left_semi").distinct()
    return rows.join(hits, column, "left_anti")


def write_once(path: str, column: str = "smiles") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each string of ``column`` once over all batches and restarts; null strings go."""

    def handle(rows: DataFrame, batch: int) -> None:
        fresh = unseen(rows.filter(F.col(column).isNotNull()).dropDuplicates([column]), column, path, batch)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def write_ledger_batches(folder: str, column: str = "smiles", order: str = "mol_id", convert: Convert | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the ledger's three outputs, a folder a batch: ``converted`` as CSV, ``failed`` as TSV with
    reasons, ``stats`` as JSON over all batches so far. A string whose converted form an earlier batch had is a duplicate."""

    def handle(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        judged = convert_with_ledger(rows, convert, column, order)
        keys = f"{folder}/keys"
        passing = judged.filter("outcome = 'ok'")
        fresh = unseen(passing, "converted", keys, batch)
        again = passing.join(fresh.select(order), order, "left_anti").withColumn("outcome", F.lit("Duplicate SMILES"))
        done = stored(fresh.unionByName(again).unionByName(judged.filter("outcome <> 'ok'")))
        ok, failed = done.filter("outcome = 'ok'"), done.filter("outcome <> 'ok'")
        ok.select(column, "converted").write.mode("overwrite").option("header", True).csv(f"{folder}/converted/batch={batch}")
        failed.select(column, F.col("outcome").alias("Reason")).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/failed/batch={batch}")
        counts = done.groupBy("outcome").agg(F.count("*").alias("n"))
        before = earlier(spark, f"{folder}/counts", counts.schema, batch)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch}")
        total = counts.unionByName(before).groupBy("outcome").agg(F.sum("n").alias("n"))
        total.coalesce(1).write.mode("overwrite").json(f"{folder}/stats/batch={batch}")
        # last, so that a batch that others see as earlier is whole
        ok.select("converted").write.mode("overwrite").parquet(f"{keys}/batch={batch}")

    return handle


def run_sink(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """What is new, batch by batch, then stops."""
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
