"""Binding pockets: a distance join on a grid, and the residues it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import THREE_TO_ONE, one_letter

XYZ = ("x", "y", "z")


def within_cutoff(receptor: DataFrame, ligand: DataFrame, cutoff: float, keys: list[str]) -> DataFrame:
    """Receptor rows that have a ligand atom of the same keys within ``cutoff``.

    Space is cut into cells of the cutoff's size; a ligand atom is copied to the 27 cells around it, so the join
    is on equal keys and cells, with the exact distance as a residual filter. Cells split crowded complexes.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff).cast("long")
    rec = receptor.withColumns({f"_c{c}": cell(c) for c in XYZ})
    near = ligand.select(*keys, *[F.col(c).alias(f"_l{c}") for c in XYZ], *[cell(c).alias(f"_b{c}") for c in XYZ])
    for c in XYZ:
        near = near.withColumn(f"_c{c}", F.explode(F.sequence(F.col(f"_b{c}") - 1, F.col(f"_b{c}") + 1)))
    near = near.drop(*[f"_b{c}" for c in XYZ])
    square = sum(((F.col(c) - F.col(f"_l{c}")) * (F.col(c) - F.col(f"_l{c}")) for c in XYZ), F.lit(0.0))
    joined = rec.join(near, [*keys, *[f"_c{c}" for c in XYZ]]).filter(square <= cutoff * cutoff)
    return joined.select(*receptor.columns).distinct()


def pocket_sequence(atoms: DataFrame, cutoff: float = 10.0, unknown: str = "X", key: str = "complex_id", standard_only: bool = False) -> DataFrame:
    """(key, pocket): one-letter codes of the residues near the ligand, by chain, number and name.

    ``unknown``: the letter of other residues, or "drop". Complexes without such residues have no row.
    """
    rec, lig = atoms.filter("entity = 'rec'"), atoms.filter("entity = 'lig'")
    if standard_only:
        rec = rec.filter(F.col("resname").isin(list(THREE_TO_ONE)))
    near = within_cutoff(rec, lig, cutoff, [key]).select(key, "chain", "resnum", "resname").distinct()
    ordered = near.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("chain", "resnum", "resname"))).alias("r"))
    letters = F.transform("r", lambda x: one_letter(x["resname"], None if unknown == "drop" else unknown))
    return ordered.select(key, F.array_join(F.array_compact(letters), "").alias("pocket"))
