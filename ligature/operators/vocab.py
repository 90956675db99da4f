"""Vocabularies: built from merges, from data, from lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.tokens import SPECIALS, tokens
from .order import cap, with_position


def number_tokens(found: DataFrame, specials: list[str] = SPECIALS, bounded: bool = False) -> DataFrame:
    """(token_id, token, special): specials in their order, then ``found`` (token) sorted, one row a token. Numbered by
    ranges, or in one window where the caller's own limit bounds the list."""
    spark = found.sparkSession
    head = spark.createDataFrame([(i, t, True) for i, t in enumerate(specials)], "token_id int, token string, special boolean")
    if bounded:
        numbered = found.select("token", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("token")) - 1).alias("_at"))
    else:
        numbered = with_position(found.select("token"), ["token"], "_at")
    body = numbered.select((F.col("_at") + len(specials)).cast("int").alias("token_id"), "token", F.lit(False).alias("special"))
    return head.unionByName(body)


def vocab_from_merges(lines: DataFrame, column: str = "line") -> DataFrame:
    """(token) of merge lines: both parts and their union, of lines with exactly two fields."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    pairs = lines.select(parts.alias("p")).filter(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    return pairs.select(F.explode(F.array(a, b, F.concat(a, b))).alias("token")).filter("token <> ''").distinct()


def token_counts(df: DataFrame, column: str = "smiles", order: str = "mol_id") -> DataFrame:
    """(token, n, first_row, first_pos): the first place settles ties as a counter in reading order would.

    Where ``order`` is a whole number, a place is one decimal number, so that tokens are counted in a hash table of the
    vocabulary's size; the least struct would have Spark sort all tokens. Null rows come first.
    """
    kind = df.schema[order].dataType
    each = df.select(F.col(order).alias("row"), F.posexplode(tokens(F.col(column))).alias("pos", "token"))
    if not isinstance(kind, IntegralType):
        first = each.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first"))
        return first.select("token", "n", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    rows, most = F.lit(2**31).cast("decimal(10,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(19,0)")
    place = (F.coalesce(F.col("row").cast("decimal(19,0)"), most) * rows + F.col("pos")).cast("decimal(38,0)")
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    counted = counted.withColumn("first_pos", F.pmod("first", rows).cast("int"))
    row = ((F.col("first") - F.col("first_pos")) / rows).cast("decimal(19,0)")
    return counted.select("token", "n", F.when(row > most, row.cast(kind)).alias("first_row"), "first_pos")


def build_vocab(df: DataFrame, max_size: int = 500, max_rows: int = 0, column: str = "smiles", order: str = "mol_id") -> DataFrame:
    """The ``max_size`` most frequent tokens, numbered in alphabetical order after the specials."""
    top = token_counts(cap(df.filter(F.size(tokens(F.col(column))) > 0), [order], max_rows), column, order)
    return number_tokens(top.orderBy(F.desc("n"), "first_row", "first_pos").limit(max_size).select("token"), bounded=True)


def distinct_tokens(df: DataFrame, n: int, column: str = "smiles", order: str = "mol_id") -> DataFrame:
    return cap(df, [order], n).select(F.explode(tokens(F.col(column))).alias("token")).distinct()


def union_vocab(*lists: DataFrame) -> DataFrame:
    every = lists[0].select("token")
    for other in lists[1:]:
        every = every.unionByName(other.select("token"))
    return number_tokens(every.distinct())


def encode_by_join(df: DataFrame, vocab: DataFrame, key: str, column: str = "smiles") -> DataFrame:
    """(key, ids, n_unknown) through a join, for vocabularies too large for a literal map; order kept."""
    each = df.select(key, F.posexplode(tokens(F.col(column))).alias("pos", "token")).join(vocab.select("token", "token_id"), "token", "left")
    by = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("s"), F.count_if(F.col("token_id").isNull()).alias("n_unknown"))
    return by.select(key, F.transform("s", lambda x: x["token_id"]).alias("ids"), "n_unknown")


def decode_by_join(df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, text): specials and unknown ids are left out."""
    each = df.select(key, F.posexplode(ids).alias("pos", "token_id")).join(vocab.filter("not special").select("token_id", "token"), "token_id")
    by = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return df.select(key).join(by, key, "left").select(key, F.coalesce(F.array_join(F.transform("s", lambda x: x["token"]), ""), F.lit("")).alias("text"))
