"""Plugs for toolkits: pandas functions over Arrow batches, with defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..functions.validate import is_valid
from .ledger import ledger

Convert = Callable[[pd.Series], pd.DataFrame]


def identity_key(text: Column) -> Column:
    """The default key: the tokens joined again."""
    return F.array_join(tokens(text), "")


def convert_plug(convert: Convert) -> Callable[[Column], Column]:
    """Wraps a function from strings to a frame of (processed, converted, error)."""
    return F.pandas_udf(convert, "processed string, converted string, error string")


def convert_with_ledger(df: DataFrame, convert: Convert | None = None, column: str = "smiles", order: str = "mol_id") -> DataFrame:
    """Adds processed, converted, reason and outcome; the plug runs in a stage of its own, before the verdicts."""
    if convert is None:
        key = identity_key(F.col(column))
        made = df.withColumns({"processed": F.col(column), "converted": key, "reason": F.when(key == "", "conversion_failed")})
    else:
        made = df.withColumn("_c", convert_plug(convert)(F.col(column))).select(*df.columns, "_c.processed", "_c.converted", F.col("_c.error").alias("reason"))
    return ledger(made, "converted", order)


def variants_plug(variants: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    return F.pandas_udf(variants, "array<string>")


def variants_table(df: DataFrame, make: Callable[[str, int], str | None], n: int, column: str = "smiles", first: Callable[[str], str] | None = None) -> DataFrame:
    """(text, variant_no, variant): up to ``n`` different variants of each different string, by a table function over
    the rows of that string, so repeated strings are worked on once.

    ``make(text, attempt)`` is asked 3 n times at most, with attempts 0, 1, ...; null is a failed attempt, and a repeat doesn't count
    as a variant. ``first`` puts a canonical form before them. Null and blank strings, and those for which a plug raises ValueError, have none.
    """

    class Variants:
        def __init__(self) -> None:
            self.done = False

        def eval(self, row: Row) -> Iterator[tuple[str, int, str]]:
            text = row[0]
            if self.done or text is None or not text.strip():
                return
            self.done = True
            try:
                found = {first(text): None} if first else {}  # in order
                for attempt in range(3 * n):
                    if len(found) >= n:
                        break
                    variant = make(text, attempt)
                    if variant is not None:
                        found[variant] = None
            except ValueError:
                return
            for k, variant in enumerate(found):
                yield text, k, variant

    table = F.udtf(Variants, returnType="text string, variant_no int, variant string")
    return table(df.select(column).asTable().partitionBy(column))


def property_plug(properties: Callable[[pd.Series], pd.DataFrame], schema: str) -> Callable[[Column], Column]:
    return F.pandas_udf(properties, schema)


def with_properties(df: DataFrame, properties: Callable[[pd.Series], pd.DataFrame], schema: str, column: str = "smiles", known: DataFrame | None = None, name: str = "properties") -> DataFrame:
    """Adds ``name``, a struct by ``schema``: from the table ``known`` (``column`` and the columns of the schema) where it has
    the string, and else from the plug, which sees each other string once however often it stands in ``df``.

    The struct is null for a null string, and for one of which the plug gives nulls only. A string that ``known`` repeats
    takes its smallest row. Rows of ``df`` are neither lost nor repeated.
    """
    strings = df.select(F.col(column).alias("_key")).filter("_key is not null").distinct()
    fields = df.sparkSession.createDataFrame([], schema).schema
    have = None
    if known is not None:
        row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        have = known.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.min(row).alias(name))
        strings = strings.join(have, "_key", "left_anti")
    plug = property_plug(properties, schema).asNondeterministic()  # else the filter below has it evaluated again for each field
    made = strings.select("_key", plug(F.col("_key")).alias(name))
    made = made.filter(F.coalesce(*[F.col(f"{name}.{f.name}").cast("string") for f in fields]).isNotNull())
    found = made if have is None else have.unionByName(made)
    return df.join(found, F.col(column) == F.col("_key"), "left").drop("_key")


def validity(text: Column, plug: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Whether a string is valid: no violations, or the toolkit's word."""
    return is_valid(text) if plug is None else F.pandas_udf(plug, "boolean")(text)
