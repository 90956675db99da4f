"""Pairs of receptors and ligands: pairing, affinity logs, prioritised keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import once
from .order import spread


def path_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def path_stem(path: Column) -> Column:
    """The name without its last suffix; a name that begins with its only dot keeps it."""
    return F.regexp_replace(path_name(path), r"(?<=[^.])\.[^.]+$", "")


def path_parent(path: Column) -> Column:
    """Name of the folder that holds the path; empty at the top."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def pair_id(protein: Column, ligand: Column) -> Column:
    return F.concat(path_parent(protein), F.lit("_"), path_stem(ligand))


def affinity_key(name: Column) -> Column:
    """Without the extension, and the marks of receptor and ligand as in structure files."""
    bare = F.replace(name, F.lit(".gninatypes"), F.lit(""))
    return F.replace(F.replace(bare, F.lit("_rec_"), F.lit("_rec.")), F.lit("_lig_"), F.lit("_lig."))


def parse_types_line(line: Column, layout: str = "reference") -> Column:
    """struct(affinity, receptor, ligand), null for lines that say nothing.

    Five fields or more are the long layout (label, weight, affinity, receptor, ligand), unless the fourth looks
    like a file; else, and with four fields, the second is the affinity. ``checked`` also asks that the third of
    a short line of five fields or more isn't a number.
    """
    def read(parts: Column) -> Column:
        get = lambda i: F.try_element_at(parts, F.lit(i))
        n = F.size(parts)
        file_like = get(4).contains("/") | get(4).endswith(".gninatypes")
        if layout == "checked":
            file_like = file_like & get(3).try_cast("double").isNull()
        short = (n == 4) | ((n >= 5) & file_like)
        affinity = F.when(short, get(2)).otherwise(get(3)).try_cast("double")
        skip = (get(1) == "") | get(1).startswith("#") | (n < 4) | affinity.isNull()
        return F.when(~skip, F.struct(affinity.alias("affinity"), F.when(short, get(3)).otherwise(get(4)).alias("receptor"), F.when(short, get(4)).otherwise(get(5)).alias("ligand")))

    return once(F.split(F.trim(line), r"\s+"), read)


def types_log(lines: DataFrame, layout: str = "reference") -> DataFrame:
    """The log's rows: all columns, and affinity, receptor, ligand.

    A generator drops the lines that say nothing: a filter would be pushed below the dealing and parse each line thrice more.
    """
    parsed = F.array_compact(F.array(parse_types_line(F.col("line"), layout)))
    return spread(lines).select(*lines.columns, F.inline(parsed).alias("affinity", "receptor", "ligand"))


def pair_by_pocket(files: DataFrame) -> DataFrame:
    """Receptors with ligands of the same pocket, from (pocket, kind, path)."""
    rec = files.filter("kind = 'rec'").select("pocket", F.col("path").alias("receptor"))
    lig = files.filter("kind = 'lig'").select("pocket", F.col("path").alias("ligand"))
    return rec.join(lig, "pocket")


def restrict_to_targets(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Log rows of target pockets (or of none) whose receptor or ligand begins with the stem of any target.

    A stem's length is one of a few, so each name is cut to those lengths and the match is an equi-join, made once for
    each different pair of names; rows come back by their names, as often as they are in the log.
    """
    targets = pairs.select(path_parent(F.col("receptor")).alias("pocket"), F.explode(F.array(path_stem(F.col("receptor")), path_stem(F.col("ligand")))).alias("stem"))
    sizes = [r["n"] for r in targets.select(F.length("stem").alias("n")).distinct().collect()]  # a few numbers
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    pockets = targets.select("pocket").distinct().unionByName(targets.sparkSession.createDataFrame([(None,)], "pocket string"))
    marked = log.withColumn("_pocket", F.when(F.col("receptor").contains("/"), F.split("receptor", "/")[0]))
    near = marked.join(pockets, F.col("_pocket").eqNullSafe(F.col("pocket")), "left_semi")
    names = F.array(*[F.element_at(F.split(affinity_key(F.col(c)), "/"), -1) for c in ("receptor", "ligand")])
    cuts = F.flatten(F.transform(names, lambda x: F.transform(F.filter(lengths, lambda n: n <= F.length(x)), lambda n: F.substr(x, F.lit(1), n))))
    tried = near.select("receptor", "ligand").distinct().withColumn("stem", F.explode(F.array_distinct(cuts)))
    hits = tried.join(targets.select("stem").distinct(), "stem", "left_semi").select("receptor", "ligand").distinct()
    return near.join(hits, ["receptor", "ligand"], "left_semi").select(*log.columns)


def affinity_table(log: DataFrame, order: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(rec_key, lig_key, affinity): two keys a line, rewritten and bare; the last line in order wins. Of ``wanted``
    keys (rec_key, lig_key) only, if given."""
    bare = lambda c: F.element_at(F.split(c, "/"), -1)
    keys = F.array(
        F.struct(affinity_key(F.col("receptor")).alias("rec_key"), affinity_key(F.col("ligand")).alias("lig_key")),
        F.struct(bare("receptor").alias("rec_key"), bare("ligand").alias("lig_key")),
    )
    each = log.select("affinity", F.struct(*order).alias("at"), F.explode(F.array_distinct(keys)).alias("k")).select("k.*", "affinity", "at")
    if wanted is not None:
        each = each.join(wanted.select("rec_key", "lig_key").distinct(), ["rec_key", "lig_key"], "left_semi")
    return each.groupBy("rec_key", "lig_key").agg(F.max_by("affinity", "at").alias("affinity"))


def candidate_keys(protein: Column, ligand: Column) -> Column:
    """Key forms in the order in which they are tried."""
    pair = lambda a, b: F.struct(a.alias("rec_key"), b.alias("lig_key"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))

    def forms(x: Column) -> Column:
        p, q = x["p_stem"], x["q_stem"]
        return F.array(
            pair(x["p"], x["q"]),
            pair(x["p_name"], x["q_name"]),
            pair(p, q),
            pair(F.concat(p, F.lit(".pdb")), F.concat(q, F.lit(".pdb"))),
            pair(F.concat(p, F.lit(".gninatypes")), F.concat(q, F.lit(".gninatypes"))),
            pair(swap(p, "_rec", "_rec_"), swap(q, "_lig", "_lig_")),
            pair(swap(x["p"], "crossdocked/", ""), swap(x["q"], "crossdocked/", "")),
        )

    names = F.struct(protein.alias("p"), ligand.alias("q"), path_name(protein).alias("p_name"), path_name(ligand).alias("q_name"), path_stem(protein).alias("p_stem"), path_stem(ligand).alias("q_stem"))
    return once(names, forms)


def keys_of(pairs: DataFrame) -> DataFrame:
    """(receptor, ligand, pos, rec_key, lig_key): the key forms of each different pair, in the order in which they are tried."""
    keyed = pairs.select("receptor", "ligand").distinct()
    return keyed.select("receptor", "ligand", F.posexplode(candidate_keys(F.col("receptor"), F.col("ligand"))).alias("pos", "k")).select("receptor", "ligand", "pos", "k.*")


def lookup_in_log(pairs: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """lookup_affinity() straight from the log: only lines that have a wanted key are grouped."""
    return lookup_affinity(pairs, affinity_table(log, order, keys_of(pairs)))


def lookup_affinity(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Adds affinity to (receptor, ligand) pairs: all key forms in one join, the first that hits wins."""
    hits = keys_of(pairs).join(table, ["rec_key", "lig_key"]).groupBy("receptor", "ligand").agg(F.min_by("affinity", "pos").alias("affinity"))
    return pairs.join(hits, ["receptor", "ligand"], "left")
