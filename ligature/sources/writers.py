"""Sinks: pairs, tables, lines, metrics, samples, summaries, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import SPECIALS


def write_pairs(df: DataFrame, path: str) -> None:
    """Headerless CSV of string, pocket and affinity."""
    df.select("smiles", "pocket_sequence", "affinity").write.option("header", False).csv(path)


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.option("header", header).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "smiles") -> None:
    df.select(column).write.text(path)


def write_clean(df: DataFrame, path: str, header: bool = False) -> None:
    """Passing rows with all their own columns; cells with commas are quoted."""
    df.filter("is_valid").drop("is_valid", "reason").write.option("header", header).csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_samples(df: DataFrame, path: str, number: str = "n", column: str = "smiles") -> None:
    """Lines "N: string", in order."""
    df.orderBy(number).select(F.concat(F.col(number).cast("string"), F.lit(": "), F.col(column)).alias("value")).write.text(path)


def write_summary(df: DataFrame, path: str, sequence: str, most: int = 1000) -> None:
    """One JSON object: the sequence, counts, and the first ``most`` valid and invalid strings (n, smiles, is_valid)."""
    pick = lambda test: F.collect_list(F.when(test, F.col("smiles")))
    shown = df.orderBy("n").limit(most).agg(pick(F.col("is_valid")).alias("valid"), pick(~F.col("is_valid")).alias("invalid"))
    counts = df.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("num_valid"))
    both = counts.crossJoin(F.broadcast(shown))  # one row each
    out = F.struct(F.lit(sequence).alias("sequence"), F.lit(len(sequence)).alias("length"), F.struct("total", "num_valid").alias("summary"), "valid", "invalid")
    both.select(F.to_json(out).alias("value")).coalesce(1).write.text(path)


def write_summary_lists(df: DataFrame, path: str) -> None:
    """The whole lists beside a summary: (n, smiles) as JSON lines in the folders is_valid=true and is_valid=false, in
    ranges of n, so neither list passes through one task. An unknown verdict counts as invalid, as in the summary's number."""
    whole = df.select("n", "smiles", F.coalesce("is_valid", F.lit(False)).alias("is_valid"))
    whole.repartitionByRange("n").sortWithinPartitions("is_valid", "n").write.partitionBy("is_valid").json(path)


def write_vocab(vocab: DataFrame, path: str, kind: str = "atom") -> None:
    """One JSON object: the tokens in the order of their ids, their number, the specials and the kind."""
    body = vocab.agg(F.array_sort(F.collect_list(F.struct("token_id", "token"))).alias("v"))  # a vocabulary is small
    tokens = F.transform("v", lambda x: x["token"])
    out = F.struct(tokens.alias("vocabulary"), F.size("v").alias("size"), F.array(*map(F.lit, SPECIALS)).alias("special_tokens"), F.lit(kind).alias("tokenizer_type"))
    body.select(F.to_json(out).alias("value")).coalesce(1).write.text(path)
