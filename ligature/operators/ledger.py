"""The conversion ledger: one outcome for each input string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``outcome`` to rows with a ``reason``: the reason, "Duplicate SMILES" for passing rows whose key came
    before, or "ok". Only passing rows are compared, by key; ``order`` tells rows apart. The first of each key comes from
    partial minima, and failing rows stand aside, so neither a frequent key nor the failures' null key gathers in a task."""
    passing, failing = df.filter("reason is null"), df.filter("reason is not null")
    first = passing.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    marked = passing.join(first, F.col(key).eqNullSafe(F.col("_key")))
    marked = marked.withColumn("outcome", F.when(F.col(order) > F.col("_first"), "Duplicate SMILES").otherwise("ok"))
    return marked.select(*df.columns, "outcome").unionByName(failing.withColumn("outcome", F.col("reason")))


def ledger_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def write_ledger(rows: DataFrame, folder: str, key: str = "smiles") -> None:
    """Successes as CSV, failures as TSV with their reasons, statistics as JSON, from one stored table."""
    rows = rows.persist()
    try:
        rows.filter("outcome = 'ok'").select(key, F.col("smiles").alias("converted")).write.option("header", True).csv(f"{folder}/converted")
        rows.filter("outcome <> 'ok'").select("smiles", F.col("outcome").alias("Reason")).write.option("sep", "\t").option("header", True).csv(f"{folder}/failed")
        ledger_stats(rows).coalesce(1).write.json(f"{folder}/stats")
    finally:
        rows.unpersist()
