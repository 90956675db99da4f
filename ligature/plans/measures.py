"""Queries on quality, candidate distributions and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.scores import reward, sa_norm
from ..operators import candidates, clean, plugs, quality, runs
from .molecules import _D_CLASS, _VOCAB, d_tokens, quoted
from .registry import query, table
from .views import view, with_views


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


# ---- quality


@query("select count(*)::bigint as total, count(*) filter (b.text is null)::bigint as novel, round(count(*) filter (b.text is null)::double / count(*), 6) as novelty from documents d left join (select distinct text from benchmark) b on d.text = b.text")
def d7_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.novelty(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark"), "text"))


def d_similarity(features: str) -> str:
    return f"f as (select mol_id, list_distinct({features}) as f from v_mol where len({features}) > 0 order by mol_id limit 100), p as (select len(list_intersect(a.f, b.f))::double / len(list_distinct(list_concat(a.f, b.f))) as s from f a join f b on a.mol_id < b.mol_id)"


@query(with_views("v_mol", f"with {d_similarity(d_tokens('smiles'))} select count(*)::bigint as pairs, round(avg(s), 6) as mean_similarity from p"))
def d8_pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select("mol_id", T.tokens(F.col("smiles")).alias("t"))
    return rounded(quality.pairwise_jaccard(mol, "mol_id", "t"))


_T = d_tokens("smiles")
_GRAMS = f"(case when len({_T}) < 2 then [array_to_string({_T}, ' ')] else list_transform(generate_series(1, len({_T}) - 1), lambda i: {_T}[i] || ' ' || {_T}[i + 1]) end)"


@query(with_views("v_mol", f"with {d_similarity(_GRAMS)} select count(*)::bigint as pairs, round(1 - avg(s), 6) as diversity from p"))
def d9_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select("mol_id", quality.ngrams(T.tokens(F.col("smiles"))).alias("g"))
    return rounded(quality.diversity(mol, "mol_id", "g"))


@query(with_views("v_mol", f"with f as (select list_sort(list_distinct({_GRAMS})) as f from v_mol), c as (select f, count(*)::double as n, row_number() over (order by f) as i from f where len(f) > 0 group by f), p as (select sum(a.n * b.n * len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f)))) as s from c a join c b on a.i < b.i), t as (select sum(n) as n, sum(n * (n - 1) / 2) as w from c) select (n * (n - 1) / 2)::bigint as pairs, round(1 - (w + coalesce(s, 0)) / (n * (n - 1) / 2), 6) as diversity from t, p"))
def d9_diversity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select(quality.ngrams(T.tokens(F.col("smiles"))).alias("g"))
    return rounded(quality.diversity_all(mol, "g"))


@query(with_views("v_mol", f"with f as (select {_GRAMS} as f from v_mol), m as (select k, list_min(list_transform(f, lambda g: md5(k || ':' || g))) as m from f, range(64) as r(k) where len(f) > 0), w as (select k, m, count(*)::double as w from m group by k, m), e as (select k, sum(w) as n, sum(w * (w - 1) / 2) as equal from w group by k) select (any_value(n) * (any_value(n) - 1) / 2)::bigint as pairs, round(1 - avg(equal / (n * (n - 1) / 2)), 6) as diversity, round(stddev_samp(equal / (n * (n - 1) / 2)) / 8, 6) as error from e"))
def d9_diversity_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select(quality.ngrams(T.tokens(F.col("smiles"))).alias("g"))
    return rounded(quality.diversity_estimate(mol, "g", 64, lambda k, g: F.md5(F.concat(k.cast("string"), F.lit(":"), g))))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) as u from v), p as (select list_dot_product(a.u, b.u) as c from u a join u b on a.vec_id <> b.vec_id) select count(*)::bigint as pairs, round(avg(c), 6) as mean, round(stddev_samp(c), 6) as std from p")
def d10_cosine_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.cosine_moments(table(spark, sf_dir, "embeddings"), "embedding", 64))


@query("with v as (select vec_id, vec_id // 64 as batch, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select a.batch, list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-12) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-12)) as c from v a join v b on a.batch = b.batch and a.vec_id <> b.vec_id) select batch, count(*)::bigint as pairs, round(avg(c), 6) as mean, round(stddev_samp(c), 6) as std, round(max(c), 6) as max, round(min(c), 6) as min from p group by batch")
def d10_cosine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 64))
    return rounded(quality.cosine_summary(rows, "embedding", "batch", "vec_id"))


@query("select label, (dim - 1)::int as dim, round(avg(x), 6) as mean from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings where vec_id % 3 <> 0) group by 1, 2")
def d11_masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.masked_mean(table(spark, sf_dir, "embeddings"), "label", "embedding", F.col("vec_id") % 3 != 0))


@query("with l as (select doc_id, length(text) as s from documents order by doc_id limit 500) select count(*)::bigint as n, round(avg(s), 6) as mean, quantile_cont(s, 0.5)::double as median, min(s)::bigint as min, max(s)::bigint as max, round(stddev_pop(s), 6) as std, round(quantile_cont(s, 0.95), 6)::double as p95 from l")
def e6_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.length_stats(table(spark, sf_dir, "documents"), "doc_id", F.length("text"), 500))


@query("select count(l_extendedprice)::bigint as n, round(quantile_cont(l_extendedprice, 0.05)::double, 6) as p05, round(quantile_cont(l_extendedprice, 0.5)::double, 6) as median, round(quantile_cont(l_extendedprice, 0.95)::double, 6) as p95 from lineitem")
def e6_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.exact_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.05, 0.5, 0.95])
    return rounded(out.select("n", *[F.col("values")[k].alias(c) for k, c in enumerate(("p05", "median", "p95"))]))


@query(with_views("v_mol", f"with t as (select {_T} as t from v_mol order by mol_id limit 1000) select count(*)::bigint as n, count(distinct array_to_string(t, ' '))::bigint as unique, round(avg(len(t)), 6) as mean_length from t"))
def e7_diversity_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select("mol_id", T.tokens(F.col("smiles")).alias("t"))
    return rounded(quality.diversity_probe(mol, "mol_id", "t"))


_D_QUALITY = "count(*)::bigint as total_generated, count(*) filter (valid)::bigint as num_valid, count(distinct smiles) filter (valid)::bigint as num_unique, round(avg(qed) filter (valid), 6) as avg_qed, round(count(*) filter (valid)::double / count(*), 6) as validity, round(count(distinct smiles) filter (valid)::double / count(*) filter (valid), 6) as uniqueness"
_D_BOTH = "both_ as (select *, not contains(smiles, '>') as valid, (mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int <= 1 as is_drug_like from v_mol join v_prop using (mol_id))"


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.rule_of_five(view(spark, sf_dir, "v_mol").join(view(spark, sf_dir, "v_prop"), "mol_id"))


@query(with_views("v_mol v_prop", f"with {_D_BOTH} select {_D_QUALITY} from both_"))
def e8_generation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.generation_quality(_generated(spark, sf_dir), "smiles", ~F.col("smiles").contains(">"), F.col("qed")))


@query(with_views("v_mol v_prop", f"with {_D_BOTH} select {_D_QUALITY}, round(avg(mw) filter (valid), 6) as avg_molecular_weight, round(avg(logp) filter (valid), 6) as avg_logp, min(qed) filter (valid) as min_qed, max(qed) filter (valid) as max_qed, round(avg(is_drug_like::int) filter (valid), 6) as drug_like_share from both_"))
def e9_generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.generation_report(_generated(spark, sf_dir), "smiles", ~F.col("smiles").contains(">")))


@query(with_views("v_metric", "select run_id, phase, count(*)::bigint as batches, count(*) filter (step % 2 = 0)::bigint as rl_batches, round(avg(loss), 6) as mean_loss, round(avg(grad_norm), 6) as mean_grad_norm, round(avg(loss) filter (step % 2 = 0), 6) as rl_mean_loss, round(avg(grad_norm) filter (step % 2 = 0), 6) as rl_mean_grad_norm from v_metric group by 1, 2"))
def e11_epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.epoch_metrics(view(spark, sf_dir, "v_metric"), ["run_id", "phase"], ["loss", "grad_norm"], F.col("step") % 2 == 0))


@query(with_views("v_prop", "with r as (select mol_id % 10 as batch, (mol_id % 4 <> 0)::int as validity, case when mol_id % 4 <> 0 then qed else 0.0 end as qed, case when mol_id % 4 <> 0 then greatest(0.0, least(1.0, 1.0 - (sa - 1.0) / 9.0)) else 0.0 end as sa from v_prop) select batch, round(avg(validity + 0.5 * qed + 0.3 * sa), 6) as mean_reward, round(avg(validity), 6) as mean_validity, round(avg(qed), 6) as mean_qed, round(avg(sa), 6) as mean_sa from r group by 1"))
def e12_reward_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_prop")
    v = F.col("mol_id") % 4 != 0
    rows = p.select("mol_id", reward(v, F.col("qed"), sa_norm(F.col("sa")), 1.0, 0.5, 0.3).alias("reward"), v.cast("double").alias("validity"), F.when(v, F.col("qed")).otherwise(0.0).alias("qed"), F.when(v, sa_norm(F.col("sa"))).otherwise(0.0).alias("sa"))
    return rounded(quality.reward_means(rows, F.col("mol_id") % 10))


@query("select count(*)::bigint as n, count(*) filter (trim(line) <> '')::bigint as n_non_blank from (select unnest(string_split(text, chr(10))) as line from documents)")
def e13_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_count(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")), "line")


@query(with_views("v_mol", "with v as (select mol_id, source, not contains(smiles, '>') as valid, length(string_split(smiles, '.')[1]) as key from v_mol), o as (select *, arg_min(key, mol_id) over (partition by source) as original_key from v) select source, bool_and(valid) as all_valid, bool_and(valid and key = original_key) as all_equivalent, count(distinct key) filter (valid)::bigint as num_unique from o group by source"))
def e14_augmentation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_mol").withColumn("k", F.length(F.split("smiles", r"\.")[0]))
    originals = rows.groupBy("source").agg(F.min_by("k", "mol_id").alias("o"))  # the key of each brand's first molecule
    rows = rows.join(originals, "source")
    return quality.augmentation_audit(rows, "source", "o", ~F.col("smiles").contains(">"), "k")


@query(with_views("v_mol", "with d as (select distinct smiles as text from v_mol), e as (select text, k, substr(text, k % length(text) + 1) || substr(text, 1, k % length(text)) as variant from d, range(6) as r(k)), f as (select text, variant, min(k) as k from e group by text, variant), n as (select text, variant, row_number() over (partition by text order by k) - 1 as variant_no from f) select text, variant_no::int as variant_no, variant from n where variant_no < 2"))
def k2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = lambda text, k: text[k % len(text) :] + text[: k % len(text)]
    return plugs.variants_table(view(spark, sf_dir, "v_mol"), turned, 2)


@query(with_views("v_mol", f"select count(*)::bigint as n, round(avg((array_to_string(list_filter({_T}, lambda t: list_contains([{quoted(_VOCAB)}], t)), '') = smiles)::int), 6) as rate from v_mol"))
def e20_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = T.decode(T.encode(T.tokens(F.col("smiles")), _VOCAB, "unk"), _VOCAB)
    return rounded(quality.round_trip_rate(view(spark, sf_dir, "v_mol"), F.col("smiles"), back))


# ---- candidates


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 10 = 0").select(F.col("event_id").alias("tok"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 4 = 1").select(F.col("user_id").cast("long").alias("q"), F.col("event_id").alias("tok"))


@query(with_views("v_logit", "select q, tok, logit from v_logit where tok % 10 <> 0"))
def c18_block_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.block_tokens(view(spark, sf_dir, "v_logit"), _blocked(spark, sf_dir)).select("q", "tok", "logit")


_D_RUNS = "s as (select user_id::bigint as q, event_id as pos, event_id % 7 as tok, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as size from events), g as (select a.q, a.rn, a.size, a.tok as t0, b.tok as t1, c.tok as t2 from s a join s b on b.q = a.q and b.rn = a.rn + 1 left join s c on c.q = a.q and c.rn = a.rn + 2), blocked as (select distinct g.q, g.t2 as tok from g join g l on l.q = g.q and l.rn = l.size - 1 and l.t0 = g.t0 and l.t1 = g.t1 where g.t2 is not null)"


@query(f"with {_D_RUNS} select q, tok from blocked")
def d12_blocked_next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("q"), F.col("event_id").alias("pos"), (F.col("event_id") % 7).alias("tok"))
    return candidates.blocked_next_tokens(seqs, 3)


@query(with_views("v_logit", "select q, tok, logit from (select *, rank() over (partition by q order by logit desc) as r from v_logit) where r <= 5"))
def f6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_k(view(spark, sf_dir, "v_logit"), 5).select("q", "tok", "logit")


def d_nucleus(source: str, p: float) -> str:
    return f"w as (select *, exp(logit - max(logit) over (partition by q)) as w from {source}), n as (select *, coalesce(sum(w) over (partition by q order by logit desc, tok rows between unbounded preceding and 1 preceding), 0.0) / sum(w) over (partition by q) as before, row_number() over (partition by q order by logit desc, tok) as rn from w), kept as (select q, tok, logit from n where rn = 1 or before <= {p}::double)"


@query(with_views("v_logit", f"with {d_nucleus('v_logit', 0.7)} select q, tok, logit from kept"))
def f7_top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_p(view(spark, sf_dir, "v_logit"), 0.7).select("q", "tok", "logit")


@query(with_views("v_logit", f"with {_D_RUNS}, t as (select q, tok, case when tok % 4 = 1 then logit / 0.8::double / 1.2::double else logit / 0.8::double end as logit from v_logit where tok % 10 <> 0), u as (select t.* from t left join blocked b on b.q = t.q and b.tok = t.tok where b.q is null), k as (select q, tok, logit from (select *, rank() over (partition by q order by logit desc) as r from u) where r <= 10), {d_nucleus('k', 0.9)} select q, tok, round(logit, 9) as logit from kept"))
def f8_decode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candidates.decode_filter(view(spark, sf_dir, "v_logit"), _blocked(spark, sf_dir), _seen(spark, sf_dir), d12_blocked_next_tokens(spark, sf_dir), 0.8, 1.2, 10, 0.9)
    return rounded(out.select("q", "tok", "logit"), 9)


@query(with_views("v_logit", "select q, tok, round(case when tok % 4 = 1 then logit / 1.2::double else logit end, 9) as logit from v_logit"))
def f9_repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.repetition_penalty(view(spark, sf_dir, "v_logit"), _seen(spark, sf_dir), 1.2).select("q", "tok", "logit"), 9)


_D_STATE = rf"""each as (select mol_id, t, pos, {_D_CLASS} as class from (select mol_id, unnest({_T}) as t, generate_subscripts({_T}, 1) - 1 as pos from v_mol)),
  state as (select *, coalesce(sum(case class when 'paren_open' then 1 when 'paren_close' then -1 else 0 end) over b, 0)::bigint as paren_balance,
      coalesce(last_value(case when class in ('atom', 'aromatic_atom', 'bracket_atom', 'bond', 'stereo') then class end ignore nulls) over b, 'other') as last_class,
      lag(t) over (partition by mol_id order by pos) as last_token,
      pos - coalesce(max(case when class in ('atom', 'aromatic_atom', 'bracket_atom') then pos end) over b, -1) - 1 as tokens_since_atom
    from each window b as (partition by mol_id order by pos rows between unbounded preceding and 1 preceding)),
  ringed as (select *, case when class = 'ring_digit' then row_number() over (partition by mol_id, class, replace(t, '%', '') order by pos) end as nth from state),
  changes as (select r.*, case when nth is null then 0 when nth % 2 = 1 then 1 else -1 end as change,
      case when nth is null then 0 when nth % 2 = 1 then (last_class = 'aromatic_atom')::int else (select (o.last_class = 'aromatic_atom')::int from ringed o where o.mol_id = r.mol_id and o.class = 'ring_digit' and replace(o.t, '%', '') = replace(r.t, '%', '') and o.nth = r.nth - 1) end as aromatic from ringed r),
  full_state as (select *, coalesce(sum(change) over b, 0)::bigint as open_rings, coalesce(sum(change * aromatic) over b, 0)::bigint as aromatic_depth from changes window b as (partition by mol_id order by pos rows between unbounded preceding and 1 preceding))"""


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mol").select("mol_id", T.tokens(F.col("smiles")).alias("t"))


@query(with_views("v_mol", f"with {_D_STATE} select mol_id, pos::int as pos, t as token, class, paren_balance, open_rings, aromatic_depth, last_class, tokens_since_atom::bigint as tokens_since_atom from full_state"))
def f11_prefix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candidates.prefix_state(_tokenised(spark, sf_dir), "mol_id", "t")
    return out.select("mol_id", "pos", "token", "class", "paren_balance", "open_rings", "aromatic_depth", "last_class", "tokens_since_atom")


_D_RULE = "case when pos = 0 and class not in ('atom', 'aromatic_atom', 'bracket_atom') then 'start' when class = 'ring_digit' and t = last_token then 'same_ring_twice' when class = 'stereo' and last_class = 'stereo' then 'stereo_after_stereo' when class = 'stereo' and tokens_since_atom > 2 then 'stereo_far_from_atom' when class = 'bond' and last_class = 'bond' then 'bond_after_bond' when class = 'paren_close' and paren_balance <= 0 then 'close_without_open' when class = 'paren_close' and last_token = '(' then 'empty_paren'"


def _suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules with endings that break rules."""
    odd = F.element_at(F.array(*map(F.lit, ["", "==C", ")C", "//C", "C11", "()C", "=C(", "C=/C"])), (F.col("mol_id") % 8 + 1).cast("int"))
    return view(spark, sf_dir, "v_mol").select("mol_id", T.tokens(F.concat("smiles", odd)).alias("t"))


_D_ODD = "v_mol as (select mol_id, smiles || ['', '==C', ')C', '//C', 'C11', '()C', '=C(', 'C=/C'][mol_id % 8 + 1] as smiles from v_base)"
_ODD_STATE = with_views("v_mol", "select 1").replace("v_mol as (", "v_base as (", 1).removesuffix(" select 1") + f", {_D_ODD}, {_D_STATE}"


@query(f"{_ODD_STATE}, broken as (select *, {_D_RULE} end as rule from full_state) select mol_id, pos::int as pos, token, rule from (select mol_id, pos, t as token, rule, row_number() over (partition by mol_id order by pos) as rn from broken where rule is not null) where rn = 1")
def f12_grammar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.grammar_audit(_suffixed(spark, sf_dir), "mol_id", "t")


@query(f"{_ODD_STATE} select mol_id, pos::int as pos, t as token, (class = 'paren_close' and paren_balance <= 0) or (class in ('bond', 'stereo') and coalesce(last_token in ('=', '#', '-', '/', '\\'), false)) as blocked, (case when regexp_matches(t, '^[0-9]$') and nth % 2 = 1 and open_rings >= 3 then 0.5 else 1.0 end)::double as factor from full_state")
def f13_light_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.light_constraints(_suffixed(spark, sf_dir), "mol_id", "t")


@query(with_views("v_logit", "with h as (select tok % 5 as pred, q % 5 as label from v_logit) select count(*)::bigint as total, count(*) filter (label <> 0)::bigint as real, round(avg((pred = label)::int), 6) as accuracy, round(avg((pred = label)::int) filter (label <> 0), 6) as real_accuracy, round(avg((pred = label)::int) filter (label = 0), 6) as pad_accuracy from h"))
def e17_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_logit").select((F.col("tok") % 5).alias("pred"), (F.col("q") % 5).alias("label"))
    return rounded(candidates.token_accuracy(rows))


_D_LOGP = "x as (select q, tok, greatest(-{0}::double, least({0}::double, logit)) as x from v_logit), l as (select q, tok, x - m - ln(sum(exp(x - m)) over (partition by q)) as logp from (select *, max(x) over (partition by q) as m from x))"


@query(with_views("v_logit", f"with {_D_LOGP.format('10.0')}, c as (select q, -arg_min(logp, tok) as nll, -avg(logp) as flat from l group by q) select count(*)::bigint as n, round(avg(0.9 * nll + 0.1 * flat), 6)::double as loss, round(exp(avg(0.9 * nll + 0.1 * flat)), 6)::double as perplexity from c"))
def e18_smoothed_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_logit").withColumn("first", F.min("tok").over(Window.partitionBy("q")))
    return rounded(candidates.smoothed_ce(rows, F.col("tok") == F.col("first")))


@query(with_views("v_logit", f"with {_D_LOGP.format('1e30')}, h as (select q, -sum(exp(logp) * ln(exp(logp) + 1e-8)) as h from l group by q) select count(*)::bigint as n, round(avg(h), 6) as mean_entropy from h"))
def e19_mean_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.mean_entropy(view(spark, sf_dir, "v_logit")))


# ---- runs

_D_STABLE = """b as (select *, row_number() over r as n, coalesce(loss < min(case when not isnan(loss) then loss end) over (r rows between unbounded preceding and 1 preceding), not isnan(loss)) as better from v_metric window r as (partition by run_id order by step)),
  s as (select *, n - coalesce(max(case when better then n end) over (partition by run_id order by step), 0) as since from b),
  a as (select *, n >= 20 as warm,
      min((loss < 1e-6)::int) over (r rows between 9 preceding and current row) = 1 as low, max((grad_norm > 10)::int) over (r rows between 9 preceding and current row) = 1 as steep,
      max((isnan(loss) or isinf(loss))::int) over (r rows between 4 preceding and current row) = 1 as broken,
      since > 30 and len(list_distinct(list(round(loss, 8)) over (r rows between 19 preceding and current row))) <= 2 as flat,
      avg(loss) over (r rows between 19 preceding and 10 preceding) as early, avg(loss) over (r rows between 9 preceding and current row) as late,
      stddev_samp(grad_norm) over (r rows between 19 preceding and current row) / (avg(grad_norm) over (r rows between 19 preceding and current row) + 1e-8) as spread
    from s window r as (partition by run_id order by step))"""


@query(with_views("v_metric", f"with {_D_STABLE} select run_id, step, since::bigint as steps_since_best, warm and low as numerical_instability, warm and steep as exploding_gradients, warm and broken as non_finite_loss, warm and flat as complete_stagnation, case when warm then case when n < 20 then 'insufficient_data' when late < early * 0.95 then 'improving' when late > early * 1.05 then 'degrading' else 'stable' end end as trend, case when warm then case when n < 20 then 'insufficient_data' when spread > 2.0 then 'unstable' else 'stable' end end as grad_stability, warm and (low or steep or broken or flat) as is_unstable from a"))
def f14_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.stability(view(spark, sf_dir, "v_metric"), patience=30, warm=20)
    return out.select("run_id", "step", "steps_since_best", "numerical_instability", "exploding_gradients", "non_finite_loss", "complete_stagnation", "trend", "grad_stability", "is_unstable")


@query(with_views("v_metric", "with d as (select run_id as seq_id, step, loss / 100.0::double as value, grad_norm / 10.0::double as reward, coalesce(lead(loss / 100.0::double) over (partition by run_id order by step), 0.0) as ahead from v_metric), e as (select *, reward + 0.99::double * ahead - value as delta from d), a as (select x.seq_id, x.step, any_value(x.value) as value, sum(pow(0.99::double * 0.95::double, y.step - x.step) * y.delta) as advantage from e x join e y on x.seq_id = y.seq_id and y.step >= x.step group by 1, 2) select seq_id, step, round(advantage, 6) as advantage, round(advantage + value, 6) as returns, round((advantage - avg(advantage) over ()) / (stddev_samp(advantage) over () + 1e-8), 6) as normalised from a"))
def f15_gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_metric").select(F.col("run_id").alias("seq_id"), "step", (F.col("loss") / F.lit(100.0)).alias("value"), (F.col("grad_norm") / F.lit(10.0)).alias("reward"))
    return rounded(runs.gae(rows))


@query(with_views("v_metric", "with b as (select *, min(case when not isnan(loss) then loss end) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as least_before from v_metric) select run_id, step, not isnan(loss) and (least_before is null or loss < least_before) as is_best, least(least_before, case when not isnan(loss) then loss end) as best_loss from b"))
def f16_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.best_so_far(view(spark, sf_dir, "v_metric"), "run_id", "step", "loss").select("run_id", "step", "is_best", "best_loss")


@query(with_views("v_metric", "with p as (select run_id, step, 4.0::double / (4.0 + exp((step - 1) / 4.0::double)) as tf, case when step < 3 then 0.0 else least(0.5, (step - 3) / 20.0::double) end as rl from v_metric) select run_id, step, round(tf, 9) as tf_expected, round(case when step % 5 = 0 then tf + 0.1 else tf end, 9) as tf_logged, round(rl, 9)::double as rl_expected, round(case when step % 7 = 0 then rl / 2 else rl end, 9)::double as rl_logged from p where step % 5 = 0 or (step % 7 = 0 and rl > 2e-6)"))
def i13_schedule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scores import rl_weight, tf_prob

    e = F.col("step") - 1
    tf, rl = tf_prob("inverse_sigmoid", e, 20), rl_weight(e, 2)
    logged = F.when(F.col("step") % 5 == 0, tf + 0.1).otherwise(tf), F.when(F.col("step") % 7 == 0, rl / 2).otherwise(rl)
    out = runs.schedule_audit(view(spark, sf_dir, "v_metric"), e, *logged, 20)
    return rounded(out.select("run_id", "step", "tf_expected", "tf_logged", "rl_expected", "rl_logged"), 9)


@query(with_views("v_metric", "select run_id, step, to_json({epoch: step, phase: phase, timestamp: null, train_loss: loss, train_reconstruction_loss: null, train_perplexity: null, train_accuracy: step / 8.0::double, train_entropy: null, val_loss: null, val_reconstruction_loss: null, val_perplexity: null, val_accuracy: null, val_entropy: null, learning_rate: 0.25::double, train_ppo_loss: step * 2, train_tf_prob: step})::varchar as record from v_metric"))
def i18_metric_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.create_map(F.lit("ppo_loss"), F.col("step") * 2, F.lit("loss_scalar"), F.col("step"), F.lit("tf_prob"), F.col("step"))
    return view(spark, sf_dir, "v_metric").select("run_id", "step", runs.metric_record({"epoch": F.col("step"), "phase": F.col("phase"), "train_loss": F.col("loss"), "train_accuracy": F.col("step") / 8, "learning_rate": F.lit(0.25)}, extra).alias("record"))


@query("with w as (select time_bucket(interval '10 minutes', ts) as start, count(*) as n from events group by 1) select start, n::bigint as n, (sum(n) over (order by start))::bigint as cumulative from w")
def j3_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import cumulative, throughput

    return cumulative(throughput(table(spark, sf_dir, "events"), "ts", "10 minutes"))
