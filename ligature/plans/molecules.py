"""Queries on molecules and sequences: tokens, checks, verdicts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.validate import DESCRIPTIONS, describe_violation, violations
from ..operators import clean
from .registry import query, table
from .views import view, with_views

P = T.TOKEN_PATTERN


def quoted(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


#: DuckDB: tokens, atom tokens, elements, charges, counts of a column.
def d_tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{P}')"


def d_elements(c: str) -> str:
    raw = rf"list_transform(list_filter({d_tokens(c)}, lambda t: regexp_matches(t, '^(\[|[A-Za-z])')), lambda t: regexp_extract(t, '{T.ELEMENT_PATTERN}', 1))"
    return f"list_filter(list_transform({raw}, lambda e: upper(substr(e, 1, 1)) || substr(e, 2, 1)), lambda e: e <> 'H')"


def d_charges(c: str) -> str:
    p = T.CHARGE_PATTERN
    return (
        rf"list_transform(list_filter({d_tokens(c)}, lambda t: starts_with(t, '[') and regexp_matches(t, '{p}')), lambda t: "
        rf"(case when starts_with(regexp_extract(t, '{p}', 1), '-') then -1 else 1 end) * "
        rf"(case when regexp_extract(t, '{p}', 2) = '' then length(regexp_extract(t, '{p}', 1)) else cast(regexp_extract(t, '{p}', 2) as int) end))"
    )


COMPOSED = f"""composed as (
  select *, {d_elements('smiles')} as elements, coalesce(list_sum({d_charges('smiles')}), 0)::int as charge,
    len(list_filter({d_charges('smiles')}, lambda x: x <> 0)) as charged_atoms,
    len(list_filter(string_split(smiles, '.'), lambda x: x <> '')) as fragments,
    len(list_filter({d_tokens('smiles')}, lambda t: regexp_matches(t, '^([0-9]|%[0-9][0-9])$'))) // 2 as ring_bonds,
    array_to_string({d_tokens('smiles')}, '') = replace(smiles, '.', '') as readable
  from v_mol)"""


def d_in(names: list[str], negate: bool = False) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(elements, lambda e: {'not ' if negate else ''}list_contains([{quoted(names)}], e)))), ',')"


CLEAN = f"""{COMPOSED}, judged as (select *, case when trim(smiles) = '' then 'empty_or_invalid_type' when contains(smiles, '>') then 'reaction_smiles'
    when length(smiles) - length(replace(smiles, '.', '')) > 2 then 'too_many_fragments' when not readable then 'parse_failed'
    when {d_in(clean.EXCLUDED)} <> '' then 'contains_metals_or_exotic: ' || {d_in(clean.EXCLUDED)}
    when {d_in(clean.DRUG_LIKE, True)} <> '' then 'non_druglike_atoms: ' || {d_in(clean.DRUG_LIKE, True)}
    when abs(charge) > 2 then 'high_charge: ' || charge when charged_atoms > 3 then 'too_many_charged_atoms'
    when len(elements) < 3 then 'too_small' when len(elements) > 100 then 'too_large' end as reason from composed)"""


@query(with_views("v_mol", f"with {CLEAN} select mol_id, smiles, reason is null as is_valid, reason from judged"))
def c1_clean_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_clean_verdict(view(spark, sf_dir, "v_mol")).select("mol_id", "smiles", "is_valid", "reason")


@query(with_views("v_mol", f"with {CLEAN}, t as (select count(*) as total, count(*) filter (reason is null) as valid from judged) select reason, count(*)::bigint as n, round(100.0 * count(*)::double / any_value(total), 6) as pct, any_value(total)::bigint as total, any_value(valid)::bigint as valid, any_value(total - valid)::bigint as rejected from judged, t where reason is not null group by reason"))
def e1_rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean.with_clean_verdict(view(spark, sf_dir, "v_mol"))
    return clean.rejection_report(judged).withColumn("pct", F.round("pct", 6))


FRAGMENTS = f"""fragments as (select mol_id, part, pos, len({d_elements('part')}) as atoms from (
    select mol_id, unnest(string_split(smiles, '.')) as part, generate_subscripts(string_split(smiles, '.'), 1) as pos from v_mol)),
  largest as (select mol_id, part from (select *, row_number() over (partition by mol_id order by atoms desc, pos) as rn from fragments) where rn = 1)"""
FILTER = f"""{FRAGMENTS}, parts as (select v.mol_id, v.smiles, l.part, p.mw, p.logp, {d_elements('l.part')} as elements,
    coalesce(list_sum({d_charges('l.part')}), 0)::int as charge, array_to_string({d_tokens('v.smiles')}, '') = replace(v.smiles, '.', '') as readable
    from v_mol v join largest l using (mol_id) join v_prop p using (mol_id)),
  judged as (select *, case when trim(smiles) = '' then 'empty_molecule' when not readable then 'invalid_smiles'
    when regexp_matches(part, '{clean.METAL_PATTERN}') then 'contains_metal'
    when len(list_filter(elements, lambda e: not list_contains([{quoted(clean.ALLOWED)}], e))) > 0 then 'contains_metal'
    when mw < 150 or mw > 500 then 'molecular_weight_out_of_range' when logp >= 5 then 'logp_out_of_range'
    when len(elements) > 200 then 'too_many_atoms' when charge <> 0 then 'charged_structure' else 'valid' end as reason from parts)"""


def _with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").join(view(spark, sf_dir, "v_prop"), "mol_id")


@query(with_views("v_mol v_prop", f"with {FILTER} select mol_id, reason = 'valid' as is_valid, reason, case when reason = 'valid' then part end as processed from judged"))
def c2_filter_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_filter_verdict(_with_properties(spark, sf_dir)).select("mol_id", "is_valid", "reason", "processed")


@query(with_views("v_mol", f"select mol_id, regexp_matches(smiles, '{clean.METAL_PATTERN}') as has_metal from v_mol"))
def c3_has_metal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", clean.has_metal(F.col("smiles")).alias("has_metal"))


@query(with_views("v_mol", f"select mol_id, len(list_filter({d_elements('smiles')}, lambda e: not list_contains([{quoted(clean.ALLOWED)}], e))) = 0 as allowed from v_mol"))
def c4_elements_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", clean.elements_allowed(F.col("smiles")).alias("allowed"))


@query(with_views("v_mol", f"with {FRAGMENTS} select mol_id, part as fragment from largest"))
def c5_largest_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", clean.largest_fragment(F.col("smiles")).alias("fragment"))


def d_balance(name: str, o: str, c: str) -> str:
    """last and low of the running count, frozen where it first falls below 0."""
    return f"""{name} as (select mol_id, coalesce(min(run), 0) as low, case when min(run) < 0 then -1 else coalesce(max_by(run, pos), 0) end as last
    from (select mol_id, pos, sum(case when ch = '{o}' then 1 else -1 end) over (partition by mol_id order by pos) as run
      from (select mol_id, unnest(string_split(smiles, '')) as ch, generate_subscripts(string_split(smiles, ''), 1) as pos from v_mol) where ch in ('{o}', '{c}')) group by mol_id)"""


def d_pairs(b: str, o: str, c: str, close: str, unclosed: str, extra: str, empty: str) -> str:
    return f"[case when coalesce({b}.low, 0) < 0 then '{close}' end, case when coalesce({b}.last, 0) > 0 then '{unclosed}' end, case when coalesce({b}.last, 0) < 0 then '{extra}' end, case when contains(smiles, '{o}{c}') then '{empty}' end]"


VIOLATIONS = rf"""{d_balance('br', '[', ']')}, {d_balance('pa', '(', ')')},
  ring as (select mol_id, list(name order by pos1) as names from (
    select mol_id, min(pos1) as pos1, case when count(*) = 1 then 'unclosed_ring_' || d when count(*) > 2 then 'duplicate_ring_' || d end as name
    from (select mol_id, regexp_replace(unnest(regexp_extract_all(smiles, '%?\d+')), '^%?0*(\d)', '\1') as d, generate_subscripts(regexp_extract_all(smiles, '%?\d+'), 1) as pos1 from v_mol)
    group by mol_id, d) group by mol_id),
  found as (select v.mol_id, v.smiles, list_filter(list_concat(
      {d_pairs('br', '[', ']', 'bracket_close_without_open', 'unclosed_brackets', 'extra_bracket_close', 'empty_brackets')},
      {d_pairs('pa', '(', ')', 'paren_close_without_open', 'unclosed_parentheses', 'extra_paren_close', 'empty_parentheses')},
      coalesce(ring.names, []),
      [case when left(smiles, 1) in ('=', '#', '-') then 'starts_with_bond' end, case when right(smiles, 1) in ('=', '#', '-') then 'ends_with_bond' end,
       case when regexp_matches(smiles, '==|##|--') then 'consecutive_bonds' end, case when regexp_matches(smiles, '\([=#-]') then 'bond_after_open_paren' end,
       case when regexp_matches(smiles, '[=#-]\)') then 'bond_before_close_paren' end,
       case when left(smiles, 1) in ('/', '\') then 'starts_with_stereo' end, case when right(smiles, 1) in ('/', '\') then 'ends_with_stereo' end,
       case when regexp_matches(smiles, '[/\\][/\\]') then 'consecutive_stereo' end,
       case when not regexp_matches(smiles, '^[bcnops\[A-Z]') then 'invalid_start_token' end, case when left(smiles, 1) in (']', ')') then 'starts_with_closure' end,
       case when regexp_matches(smiles, '^[0-9%]') then 'starts_with_ring_digit' end,
       case when length(regexp_replace(smiles, '[^bcnosp]', '', 'g')) > 3 and not regexp_matches(smiles, '\d') then 'aromatic_without_rings' end]), lambda x: x is not null) as found
    from v_mol v left join br using (mol_id) left join pa using (mol_id) left join ring using (mol_id))"""


@query(with_views("v_mol", f"with {VIOLATIONS} select mol_id, len(found) = 0 as is_valid, array_to_string(found, '|') as violations from found"))
def c6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "v_mol").select("mol_id", violations(F.col("smiles")).alias("found"))
    return found.select("mol_id", (F.size("found") == 0).alias("is_valid"), F.array_join("found", "|").alias("violations"))


_DESCRIBED = " ".join(f"when '{k}' then '{v}'" for k, v in DESCRIPTIONS.items())


@query(with_views("v_mol", f"with {VIOLATIONS}, each as (select distinct unnest(found) as violation from found) select violation, case when starts_with(violation, 'unclosed_ring_') then 'Ring closure ' || string_split(violation, '_')[-1] || ' is unclosed' when starts_with(violation, 'duplicate_ring_') then 'Ring digit ' || string_split(violation, '_')[-1] || ' used more than twice' else case violation {_DESCRIBED} else 'Unknown violation: ' || violation end end as description from each"))
def c7_violation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "v_mol").select(F.explode(violations(F.col("smiles"))).alias("violation")).distinct()
    return names.select("violation", describe_violation(F.col("violation")).alias("description"))


@query(with_views("v_mol", f"with {VIOLATIONS}, each as (select mol_id, smiles, unnest(found) as violation from found), t as (select count(*) as total, count(*) filter (len(found) = 0) as valid from found), ranked as (select *, row_number() over (partition by violation order by mol_id) as rn from each) select violation, count(*)::bigint as n, round(100.0 * count(*)::double / any_value(total), 6) as pct, any_value(total)::bigint as total, any_value(valid)::bigint as valid, round(100.0 * any_value(valid)::double / any_value(total), 6) as validity_rate, string_agg(smiles, '|' order by mol_id) filter (rn <= 3) as examples from ranked, t group by violation"))
def e2_violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.violation_report(view(spark, sf_dir, "v_mol"))
    return out.withColumns({"pct": F.round("pct", 6), "validity_rate": F.round("validity_rate", 6), "examples": F.array_join("examples", "|")})


_AMINO = "".join(T.AMINO_ACIDS)


@query(with_views("v_seq", f"select seq_id, seq <> '' and not regexp_matches(seq, '[^{_AMINO}]') as is_valid, array_to_string(list_sort(list_distinct(list_filter(string_split(seq, ''), lambda c: c <> '' and not contains('{_AMINO}', c)))), '') as invalid, length(seq) < 10 as is_short, length(seq) > 1000 as is_long from v_seq"))
def c8_protein_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "v_seq").select("seq_id", clean.protein_check(F.col("seq")).alias("c"))
    return out.select("seq_id", "c.is_valid", F.array_join("c.invalid", "").alias("invalid"), "c.is_short", "c.is_long")


@query(with_views("v_seq", f"select distinct c as symbol from (select unnest(string_split(seq, '')) as c from v_seq) where c <> '' and not contains('{_AMINO}', c)"))
def h2_invalid_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_seq").select(F.explode(clean.invalid_symbols(F.col("seq"))).alias("symbol")).distinct()


@query(with_views("v_seq", "select length(seq) between 10 and 500 as length_ok, count(*)::bigint as n from v_seq group by 1"))
def c9_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.length_gate(view(spark, sf_dir, "v_seq"), "seq").groupBy("length_ok").agg(F.count("*").alias("n"))


@query("select event_id, trim(event_type) as event_type, value from events where value is not null and not isnan(value) and trim(event_type) <> ''")
def c10_drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_incomplete(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type", "value"])


@query(with_views("v_seq", f"select seq_id, len({d_tokens('seq')}) > 0 as is_tokenizable from v_seq"))
def c11_is_tokenizable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_seq").select("seq_id", T.is_tokenizable(F.col("seq")).alias("is_tokenizable"))


_VOCAB = T.default_vocabulary()
_D_IDS = f"list_transform({d_tokens('smiles')}, lambda t: list_position([{quoted(_VOCAB)}], t) - 1)"


@query(with_views("v_mol", f"select mol_id, array_to_string(case when list_contains(list_transform({_D_IDS}, lambda i: coalesce(i, -1)), -1) then null else list_concat([1], {_D_IDS}, [2]) end, ',') as dropped, array_to_string(list_concat([1], list_transform({_D_IDS}, lambda i: case when coalesce(i, -1) < 0 then 4 else i end), [2]), ',') as with_unk from v_mol"))
def c12_unknown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = T.tokens(F.col("smiles"))
    return view(spark, sf_dir, "v_mol").select("mol_id", F.array_join(T.encode(toks, _VOCAB), ",").alias("dropped"), F.array_join(T.encode(toks, _VOCAB, "unk"), ",").alias("with_unk"))


_RO5 = "(mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int"


@query(with_views("v_prop", f"select mol_id, {_RO5} as lipinski_violations, {_RO5} <= 1 as is_drug_like from v_prop"))
def c14_rule_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.rule_of_five(view(spark, sf_dir, "v_prop")).select("mol_id", "lipinski_violations", "is_drug_like")


@query(with_views("v_mol v_prop", f"with {FILTER} select case when reason = 'valid' then 'passed' else reason end as outcome, count(*)::bigint as n, min(case when reason = 'valid' then part else smiles end) as first_string from judged group by 1"))
def c15_filter_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = clean.filter_batch(_with_properties(spark, sf_dir))
    both = passed.select(F.lit("passed").alias("outcome"), F.col("processed").alias("s")).unionByName(rejected.select(F.col("reason").alias("outcome"), F.col("smiles").alias("s")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.min("s").alias("first_string"))


@query("select event_id, value is not null and not isnan(value) as affinity_found, case when value is null or isnan(value) then 5.0::double else value end as affinity from events")
def c16_fill_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_affinity(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("affinity")))


PAIRS = f"pairs as (select seq_id, case when seq_id % 9 = 0 then '' else seq end as pocket, case when seq_id % 7 = 0 then '' else smiles end as smiles, case when seq_id % 5 = 0 then null else mol_id % 11 / 2.0::double end as affinity from v_seq join v_mol on mol_id = 1 + seq_id % 100), outcomes as (select *, case when pocket = '' then 'failed_pocket' when length(pocket) not between 10 and 500 then 'invalid_length' when smiles = '' then 'failed_smiles' else 'ok' end as outcome from pairs)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, mol = view(spark, sf_dir, "v_seq"), view(spark, sf_dir, "v_mol")
    both = seq.withColumn("mol_id", 1 + F.col("seq_id") % 100).join(mol, "mol_id")
    return both.select(
        "seq_id",
        F.when(F.col("seq_id") % 9 == 0, "").otherwise(F.col("seq")).alias("pocket"),
        F.when(F.col("seq_id") % 7 == 0, "").otherwise(F.col("smiles")).alias("smiles"),
        F.when(F.col("seq_id") % 5 != 0, (F.col("mol_id") % 11).cast("double") / 2).alias("affinity"),
    )


@query(with_views("v_seq v_mol", f"with {PAIRS} select seq_id, outcome from outcomes"))
def c17_pair_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_outcome(_pairs(spark, sf_dir)).select("seq_id", "outcome")


@query(with_views("v_seq v_mol", f"with {PAIRS} select count(*)::bigint as total, count(*) filter (outcome = 'ok')::bigint as successful, count(*) filter (outcome = 'failed_pocket')::bigint as failed_pocket, count(*) filter (outcome = 'invalid_length')::bigint as invalid_length, count(*) filter (outcome = 'failed_smiles')::bigint as failed_smiles, round(100.0 * count(*) filter (outcome = 'ok')::double / count(*), 6) as success_pct, count(*) filter (outcome = 'ok' and affinity is not null)::bigint as affinity_found, count(*) filter (outcome = 'ok' and affinity is null)::bigint as affinity_missing, round(avg(coalesce(affinity, 5.0)) filter (outcome = 'ok'), 6) as mean_affinity, min(coalesce(affinity, 5.0)) filter (outcome = 'ok') as min_affinity, max(coalesce(affinity, 5.0)) filter (outcome = 'ok') as max_affinity, round(avg(length(pocket)) filter (outcome = 'ok'), 6) as mean_length, (min(length(pocket)) filter (outcome = 'ok'))::bigint as min_length, (max(length(pocket)) filter (outcome = 'ok'))::bigint as max_length from outcomes"))
def e10_funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.funnel_report(clean.fill_affinity(clean.with_outcome(_pairs(spark, sf_dir))))


@query(with_views("v_mol", f"with {CLEAN} select case when rn > 1 then 'Duplicate SMILES' else coalesce(reason, 'ok') end as outcome, count(*)::bigint as n from (select *, case when reason is null then row_number() over (partition by smiles, reason is null order by mol_id) else 1 end as rn from judged) group by 1"))
def e3_ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ledger import ledger, ledger_stats

    return ledger_stats(ledger(clean.with_clean_verdict(view(spark, sf_dir, "v_mol")), "smiles", "mol_id"))


@query(with_views("v_mol", f"select mol_id, array_to_string({d_tokens('smiles')}, '|') as tokens from v_mol"))
def i1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", F.array_join(T.tokens(F.col("smiles")), "|").alias("tokens"))


@query(with_views("v_mol", f"select mol_id, array_to_string(list_concat([1], list_transform({_D_IDS}, lambda i: case when coalesce(i, -1) < 0 then 4 else i end), [2]), ',') as ids from v_mol"))
def i2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", F.array_join(T.encode(T.tokens(F.col("smiles")), _VOCAB, "unk"), ",").alias("ids"))


@query(with_views("v_mol", f"select mol_id, array_to_string(list_filter({d_tokens('smiles')}, lambda t: list_contains([{quoted(_VOCAB)}], t)), '') as decoded from v_mol"))
def i3_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "v_mol").select("mol_id", T.encode(T.tokens(F.col("smiles")), _VOCAB, "unk").alias("ids"))
    return ids.select("mol_id", T.decode(F.col("ids"), _VOCAB).alias("decoded"))


@query(with_views("v_mol", f"with e as (select mol_id, list_concat([1], list_transform({_D_IDS}, lambda i: case when coalesce(i, -1) < 0 then 4 else i end), [2]) as ids from v_mol), p as (select mol_id, list_resize(ids, 12, 0) as ids from e) select mol_id, array_to_string(ids, ',') as ids, array_to_string(list_transform(ids, lambda i: (i <> 0)::int), ',') as mask from p"))
def i4_pad_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "v_mol").select("mol_id", T.pad_to(T.encode(T.tokens(F.col("smiles")), _VOCAB, "unk"), 12).alias("ids"))
    return ids.select("mol_id", F.array_join("ids", ",").alias("ids"), F.array_join(T.attention_mask(F.col("ids")), ",").alias("mask"))


_D_PROTEIN = f"list_transform(list_filter(string_split(trim(upper(seq)), ''), lambda c: c <> ''), lambda c: coalesce(nullif(list_position([{quoted(T.protein_vocabulary())}], c), 0) - 1, 3))"


@query(with_views("v_seq", f"select seq_id, array_to_string(list_concat([1], {_D_PROTEIN}[:30], [2]), ',') as ids from v_seq"))
def i5_encode_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_seq").select("seq_id", F.array_join(T.encode_protein(F.col("seq"), 32), ",").alias("ids"))


@query(with_views("v_seq", f"select seq_id, array_to_string(list_filter(string_split(seq, ''), lambda c: c <> '' and contains('{_AMINO}', c)), '') as decoded from v_seq"))
def i6_decode_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "v_seq").select("seq_id", T.encode_protein(F.col("seq")).alias("ids"))
    return ids.select("seq_id", T.decode_protein(F.col("ids")).alias("decoded"))


@query(with_views("v_seq", f"with p as (select seq_id, list_resize(list_concat([1], {_D_PROTEIN}, [2])[:64], 64, 0) as ids from v_seq) select seq_id, list_sum(list_transform(ids, lambda i: (i <> 0)::int))::bigint as n_real, len(ids)::bigint as n from p"))
def i7_attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "v_seq").select("seq_id", T.pad_to(T.encode_protein(F.col("seq")), 64).alias("ids"))
    mask = T.attention_mask(F.col("ids"))
    return ids.select("seq_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"), F.size("ids").cast("long").alias("n"))


_D_ONE = "case resname " + " ".join(f"when '{k}' then '{v}'" for k, v in T.THREE_TO_ONE.items()) + " end"


@query(with_views("v_atom", f"select atom_id, coalesce({_D_ONE}, 'X') as letter, {_D_ONE} as known from v_atom"))
def i8_one_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_atom").select("atom_id", T.one_letter(F.col("resname")).alias("letter"), T.one_letter(F.col("resname"), None).alias("known"))


@query(with_views("v_mol", f"with {COMPOSED} select mol_id, len(elements)::int as atoms, array_to_string(elements, ',') as elements, charge, charged_atoms::int as charged_atoms, fragments::int as fragments, ring_bonds::int as ring_bonds, (len(elements) - fragments + ring_bonds)::int as bonds, len(list_filter(elements, lambda e: e <> 'C'))::int as hetero_atoms from composed"))
def i11_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "v_mol").select("mol_id", T.composition(F.col("smiles")).alias("c")).select("mol_id", "c.*")
    return out.withColumn("elements", F.array_join("elements", ","))


_D_CLASS = rf"case when t in ({quoted(T.SPECIALS)}) then 'special' when t like '[%]' and length(t) > 2 then 'bracket_atom' when t in ({quoted(T.ATOMS)}) then 'atom' when t in ({quoted(T.AROMATIC)}) then 'aromatic_atom' when t in ({quoted(T.BONDS)}) then 'bond' when t in ({quoted(T.STEREO)}) then 'stereo' when regexp_matches(t, '^([0-9]|%[0-9][0-9]+)$') then 'ring_digit' when t = '(' then 'paren_open' when t = ')' then 'paren_close' else 'other' end"


@query(with_views("v_mol", f"with e as (select unnest({d_tokens('smiles')}) as t from v_mol) select {_D_CLASS} as class, {_D_CLASS} in ('atom', 'aromatic_atom', 'bracket_atom') as is_atom, count(*)::bigint as n from e group by all"))
def f10_token_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = view(spark, sf_dir, "v_mol").select(F.explode(T.tokens(F.col("smiles"))).alias("t")).select(T.token_class(F.col("t")).alias("class"))
    return each.groupBy("class", T.is_atom_class(F.col("class")).alias("is_atom")).agg(F.count("*").alias("n"))
