"""Cleaning molecules: verdicts with named reasons, filters, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import AMINO_ACIDS, composition, elements, once, tokens
from ..functions.validate import violations

# Elements allowed and excluded by the cleaning rules, and metals of the filter's pattern.
DRUG_LIKE = "H C N O F P S Cl Br I B".split()
EXCLUDED = (
    "Li Na K Mg Ca Fe Cu Zn Co Ni Mn Ag Au Pt Pd Ru Rh Os Ir Al Si Ga Ge As Se Sn Sb Te "
    "Ti V Cr Mo W Nb Ta Sc Y La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Th U"
).split()
ALLOWED = "H C N O F S P Cl Br I B Si".split()
METALS = (
    "Li Na K Rb Cs Fr Be Mg Ca Sr Ba Ra Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd La Ce Pr Nd Pm "
    "Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg "
    "Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
METAL_PATTERN = r"\[(?:" + "|".join(METALS) + ")"


def readable(text: Column) -> Column:
    """No character is left over by the tokens, but fragment dots."""
    return F.array_join(tokens(text), "") == F.replace(text, F.lit("."), F.lit(""))


def has_metal(text: Column) -> Column:
    """A bracket that begins with a metal's symbol; an isotope number before it hides it."""
    return text.rlike(METAL_PATTERN)


def elements_allowed(text: Column, allowed: list[str] = ALLOWED) -> Column:
    return F.size(F.array_except(elements(text), F.array(*map(F.lit, allowed)))) == 0


def largest_fragment(text: Column) -> Column:
    """The fragment with the most atoms, the first of equals."""
    parts = F.transform(F.split(text, r"\."), lambda f, i: F.struct((-F.size(elements(f))).alias("size"), i.alias("at"), f.alias("part")))
    return F.array_min(parts)["part"]


def clean_verdict(column: Column, valid: Column | None = None) -> Column:
    """struct(is_valid, reason): the first rule that fails names the reason. ``valid``: a toolkit's word on whether
    the string parses; without it, a string with unreadable characters doesn't. Elements in reasons are sorted."""
    text = F.trim(column)

    def judge(parts: Column) -> Column:
        elems = parts["elements"]
        excluded = F.array_sort(F.array_distinct(F.filter(elems, lambda e: e.isin(EXCLUDED))))
        other = F.array_sort(F.array_distinct(F.filter(elems, lambda e: ~e.isin(DRUG_LIKE))))
        reason = (
            F.when(F.coalesce(text, F.lit("")) == "", "empty_or_invalid_type")
            .when(text.contains(">"), "reaction_smiles")
            .when(F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) > 2, "too_many_fragments")
            .when(~(readable(text) if valid is None else F.coalesce(valid, F.lit(False))), "parse_failed")
            .when(F.size(excluded) > 0, F.concat(F.lit("contains_metals_or_exotic: "), F.array_join(excluded, ",")))
            .when(F.size(other) > 0, F.concat(F.lit("non_druglike_atoms: "), F.array_join(other, ",")))
            .when(F.abs(parts["charge"]) > 2, F.concat(F.lit("high_charge: "), parts["charge"].cast("string")))
            .when(parts["charged_atoms"] > 3, "too_many_charged_atoms")
            .when(parts["atoms"] < 3, "too_small")
            .when(parts["atoms"] > 100, "too_large")
        )
        return once(reason, lambda r: F.struct(r.isNull().alias("is_valid"), r.alias("reason")))

    return once(composition(text), judge)


def with_clean_verdict(df: DataFrame, column: str = "smiles", valid: str | None = None) -> DataFrame:
    verdict = clean_verdict(F.col(column), F.col(valid) if valid else None)
    return df.withColumn("verdict", verdict).select(*df.columns, "verdict.is_valid", "verdict.reason")


def rejection_report(df: DataFrame) -> DataFrame:
    """(reason, n, pct, total, valid, rejected) of rows with a verdict, the most frequent reason first."""
    by = df.groupBy("reason").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # over one row for a reason
    total, valid = F.sum("n").over(every), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).over(every)
    out = by.select("reason", "n", (100.0 * F.col("n") / total).alias("pct"), total.alias("total"), valid.alias("valid"), (total - valid).alias("rejected"))
    return out.filter("reason is not null").orderBy(F.desc("n"), "reason")


@dataclass(frozen=True)
class FilterConfig:
    remove_fragments: bool = True
    remove_charges: bool = True
    min_weight: float = 150.0
    max_weight: float = 500.0
    max_logp: float = 5.0
    max_atoms: int = 200
    allowed: tuple[str, ...] = tuple(ALLOWED)


def filter_verdict(column: Column, weight: Column, logp: Column, config: FilterConfig = FilterConfig(), valid: Column | None = None, radical: Column | None = None, standardised: Column | None = None) -> Column:
    """struct(is_valid, reason, processed) of the drug-like filter; weight, logp and what only a toolkit knows
    (parses, is a radical, can be standardised) come in as columns."""
    text = F.trim(column)
    yes = F.lit(True)

    def judge(x: Column) -> Column:
        part, parts = x["part"], x["parts"]
        allowed = F.size(F.array_except(parts["elements"], F.array(*map(F.lit, config.allowed)))) == 0
        reason = (
            F.when(F.coalesce(text, F.lit("")) == "", "empty_molecule")
            .when(~(readable(text) if valid is None else valid), "invalid_smiles")
            .when(has_metal(part), "contains_metal")
            .when(F.lit(False) if radical is None else radical, "radical_structure")
            .when(~allowed, "contains_metal")
            .when(~(yes if standardised is None else standardised), "standardization_failed")
            .when((weight < config.min_weight) | (weight > config.max_weight), "molecular_weight_out_of_range")
            .when(logp >= config.max_logp, "logp_out_of_range")
            .when(parts["atoms"] > config.max_atoms, "too_many_atoms")
            .when(F.lit(config.remove_charges) & (parts["charge"] != 0), "charged_structure")
            .otherwise("valid")
        )
        return once(reason, lambda r: F.struct((r == "valid").alias("is_valid"), r.alias("reason"), F.when(r == "valid", part).alias("processed")))

    whole = largest_fragment(text) if config.remove_fragments else text
    return once(once(whole, lambda p: F.struct(p.alias("part"), composition(p).alias("parts"))), judge)


def with_filter_verdict(df: DataFrame, config: FilterConfig = FilterConfig(), column: str = "smiles", weight: str = "mw", logp: str = "logp") -> DataFrame:
    verdict = filter_verdict(F.col(column), F.col(weight), F.col(logp), config)
    return df.withColumn("verdict", verdict).select(*df.columns, "verdict.is_valid", "verdict.reason", "verdict.processed")


def filter_batch(df: DataFrame, config: FilterConfig = FilterConfig()) -> tuple[DataFrame, DataFrame]:
    """Passing rows with their processed strings, and the other rows by reason (a row each, so that a frequent
    reason isn't one large cell)."""
    judged = with_filter_verdict(df, config)
    return judged.filter("is_valid").drop("is_valid", "reason"), judged.filter(~F.col("is_valid")).drop("is_valid", "processed")


def violation_report(df: DataFrame, column: str = "smiles", order: str = "mol_id", examples: int = 3) -> DataFrame:
    """(violation, n, pct, total, valid, validity_rate, examples): the first strings of each violation in order."""
    checked = df.select(F.col(order).alias("at"), F.col(column).alias("text"), violations(F.col(column)).alias("found"))
    counts = checked.agg(F.count("*").alias("total"), F.count_if(F.size("found") == 0).alias("valid"))
    each = checked.select("at", "text", F.explode("found").alias("violation"))
    first = first_n(each, ["violation"], ["at"], examples).groupBy("violation").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("examples"))
    by = each.groupBy("violation").agg(F.count("*").alias("n")).join(first, "violation")
    out = by.crossJoin(F.broadcast(counts))  # one row
    return out.select("violation", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), "total", "valid", (100.0 * F.col("valid") / F.col("total")).alias("validity_rate"), "examples")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key in order; Spark keeps n a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def protein_check(column: Column) -> Column:
    """struct(is_valid, clean, invalid, is_short, is_long): only the twenty letters, after upper case and trim."""
    clean = F.trim(F.upper(column))
    return F.struct(
        ((F.coalesce(clean, F.lit("")) != "") & clean.rlike("^[" + "".join(AMINO_ACIDS) + "]*$")).alias("is_valid"),
        clean.alias("clean"),
        invalid_symbols(clean).alias("invalid"),
        (F.length(clean) < 10).alias("is_short"),
        (F.length(clean) > 1000).alias("is_long"),
    )


def invalid_symbols(column: Column) -> Column:
    """Sorted characters outside the protein alphabet."""
    return F.array_sort(F.array_except(F.filter(F.split(column, ""), lambda c: c != ""), F.array(*map(F.lit, AMINO_ACIDS))))


def length_gate(df: DataFrame, column: str, low: int = 10, high: int = 500) -> DataFrame:
    return df.withColumn("length_ok", F.length(column).between(low, high))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all there and not blank, trimmed; NaN counts as missing."""
    out = df
    for c in columns:
        kind = dict(df.dtypes)[c]
        out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.nullif(F.trim(c), F.lit("")) if kind == "string" else F.col(c))
    return out.dropna(subset=columns)


def fill_affinity(df: DataFrame, default: float | None = 5.0, column: str = "affinity") -> DataFrame:
    """Missing affinities get the default, with a flag that tells them from found ones."""
    given = F.when(~F.isnan(column), F.col(column))
    return df.withColumns({"affinity_found": given.isNotNull(), column: given if default is None else F.coalesce(given, F.lit(default))})


def with_outcome(df: DataFrame, pocket: str = "pocket", smiles: str = "smiles", low: int = 10, high: int = 500) -> DataFrame:
    """One outcome for each pair, in the order in which the stages would fail."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = F.when(missing(pocket), "failed_pocket").when(~F.length(pocket).between(low, high), "invalid_length").when(missing(smiles), "failed_smiles").otherwise("ok")
    return df.withColumn("outcome", out)


def rule_of_five(df: DataFrame) -> DataFrame:
    """Adds lipinski_violations and is_drug_like (one violation at most) from mw, logp, hbd and hba."""
    n = sum(((F.col(c) > most).cast("int") for c, most in (("logp", 5), ("hbd", 5), ("hba", 10))), (F.col("mw") > 500).cast("int"))
    return df.withColumn("lipinski_violations", n).withColumn("is_drug_like", F.col("lipinski_violations") <= 1)


def funnel_report(df: DataFrame) -> DataFrame:
    """Counts by outcome, and affinity and pocket length of the successful pairs; rates of an empty table are 0."""
    ok = F.col("outcome") == "ok"
    size = F.length("pocket")
    count = lambda test, name: F.count_if(test).alias(name)
    return df.agg(
        F.count("*").alias("total"),
        count(ok, "successful"),
        *[count(F.col("outcome") == x, x) for x in ("failed_pocket", "invalid_length", "failed_smiles")],
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(ok), F.count("*")), F.lit(0.0)), 6).alias("success_pct"),
        count(ok & F.col("affinity_found"), "affinity_found"),
        count(ok & ~F.col("affinity_found"), "affinity_missing"),
        F.round(F.avg(F.when(ok, F.col("affinity"))), 6).alias("mean_affinity"),
        F.min(F.when(ok, F.col("affinity"))).alias("min_affinity"),
        F.max(F.when(ok, F.col("affinity"))).alias("max_affinity"),
        F.round(F.avg(F.when(ok, size)), 6).alias("mean_length"),
        F.min(F.when(ok, size)).cast("long").alias("min_length"),
        F.max(F.when(ok, size)).cast("long").alias("max_length"),
    )
