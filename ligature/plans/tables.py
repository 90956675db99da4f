"""Queries on logs, pairs, splits, samples and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.scores import reward, rl_weight, sa_norm, tf_prob
from ..operators import clean, order, pairs, pocket, splits, vocab
from ..sources import readers
from .molecules import _VOCAB, d_tokens, quoted
from .registry import query, table
from .views import view, with_views

LOG_ORDER = ["file_no", "line_no", "l_partkey", "l_suppkey", "line"]

# ---- sources


@query("select p_name as smiles from part")
def a6_parquet_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet_smiles(spark, f"{sf_dir}/part.parquet", "p_name")


@query("select count(*)::bigint as n from lineitem")
def a7_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table_rows(table(spark, sf_dir, "lineitem"))


D_PARSED = r"""parts as (select *, string_split_regex(trim(line), '\s+') as p from v_types where trim(line) <> '' and not starts_with(trim(line), '#')),
  layouts as (select *, len(p) = 4 or (len(p) >= 5 and (contains(p[4], '/') or ends_with(p[4], '.gninatypes'))) as short from parts where len(p) >= 4),
  log as (select file_no, line_no, l_partkey, l_suppkey, line, try_cast(case when short then p[2] else p[3] end as double) as affinity, case when short then p[3] else p[4] end as receptor, case when short then p[4] else p[5] end as ligand
    from layouts where try_cast(case when short then p[2] else p[3] end as double) is not null)"""


@query(with_views("v_types", f"with {D_PARSED} select file_no, line_no, affinity, receptor, ligand from log"))
def a13_types_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.types_log(view(spark, sf_dir, "v_types")).select("file_no", "line_no", "affinity", "receptor", "ligand")


@query(r"with l as (select string_split_regex(trim(line), '\s+') as p from (select unnest(string_split(text, chr(10))) as line from documents)) select distinct unnest([p[1], p[2], p[1] || p[2]]) as token from l where len(p) = 2")
def a15_vocab_from_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return vocab.vocab_from_merges(lines)


@query("select doc_id as name from documents where doc_id % 3 <> 0")
def a18_verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("name"), F.col("text").alias("content"))
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("0" * 32)).otherwise(F.md5(F.col("text").cast("binary"))), F.lit("  file"))
    return readers.verified_files(files, docs.select(F.col("doc_id").alias("name"), line.alias("line"))).select("name")


@query("select url as name from pages where page_id % 2 = 0 or url in (select url from pages where page_id % 2 = 0)")
def a19_paired_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mates = pages.filter("page_id % 2 = 0").select(F.concat("url", F.lit(".md5")).alias("name"))
    return readers.paired_listing(pages.select(F.col("url").alias("name")).unionByName(mates))


# ---- joins


@query("with f as (select l_orderkey as pocket, l_linenumber % 2 as k, concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) as path from lineitem) select r.pocket, count(*)::bigint as pairs, count(distinct r.path)::bigint as receptors, min(r.path) as first_receptor, max(l.path) as last_ligand from f r join f l on r.pocket = l.pocket and r.k = 1 and l.k = 0 group by 1")
def d1_pair_by_pocket(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pocket"), F.when(F.col("l_linenumber") % 2 == 1, "rec").otherwise("lig").alias("kind"), path.alias("path"))
    return pairs.pair_by_pocket(files).groupBy("pocket").agg(F.count("*").alias("pairs"), F.countDistinct("receptor").alias("receptors"), F.min("receptor").alias("first_receptor"), F.max("ligand").alias("last_ligand"))


def d_near(cutoff: float) -> str:
    return f"near as (select distinct r.complex_id, r.atom_id, r.chain, r.resnum, r.resname from v_atom r join v_atom l on r.complex_id = l.complex_id and r.entity = 'rec' and l.entity = 'lig' and (r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y) + (r.z - l.z) * (r.z - l.z) <= {cutoff}::double * {cutoff}::double)"


@query(with_views("v_atom", f"with {d_near(0.1)} select complex_id, atom_id from near"))
def d2_within_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = view(spark, sf_dir, "v_atom")
    return pocket.within_cutoff(atoms.filter("entity = 'rec'"), atoms.filter("entity = 'lig'"), 0.1, ["complex_id"]).select("complex_id", "atom_id")


@query(with_views("v_atom", f"with {d_near(0.3)}, res as (select distinct complex_id, chain, resnum, resname from near) select complex_id, string_agg(case resname {' '.join(f'''when '{k}' then '{v}' ''' for k, v in T.THREE_TO_ONE.items())} else 'X' end, '' order by chain, resnum, resname) as pocket from res group by complex_id"))
def e15_pocket_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pocket.pocket_sequence(view(spark, sf_dir, "v_atom"), 0.3)


D_TARGETS = "targets as (select 'crossdocked/P' || s_suppkey || '/r' || (s_suppkey % 50) || '_rec.pdb' as receptor, 'crossdocked/P' || s_suppkey || '/l5_lig.pdb' as ligand, 'P' || s_suppkey as pocket, 'r' || (s_suppkey % 50) || '_rec' as rstem, 'l5_lig' as lstem from supplier where s_suppkey % 3 = 0)"
D_KEY = "replace(replace(replace({0}, '.gninatypes', ''), '_rec_', '_rec.'), '_lig_', '_lig.')"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey").cast("string")
    top = F.concat(F.lit("crossdocked/P"), s)
    rec = F.concat(top, F.lit("/r"), (F.col("s_suppkey") % 50).cast("string"), F.lit("_rec.pdb"))
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(rec.alias("receptor"), F.concat(top, F.lit("/l5_lig.pdb")).alias("ligand"))


@query(with_views("v_types", f"with {D_PARSED}, {D_TARGETS}, stems as (select distinct rstem as stem from targets union select lstem from targets), named as (select *, string_split({D_KEY.format('receptor')}, '/')[-1] as rn, string_split({D_KEY.format('ligand')}, '/')[-1] as ln from log) select file_no, line_no, receptor, ligand from named n where (not contains(receptor, '/') or string_split(receptor, '/')[1] in (select pocket from targets)) and exists (select 1 from stems where starts_with(rn, stem) or starts_with(ln, stem))"))
def d3_restrict_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = pairs.types_log(view(spark, sf_dir, "v_types"))
    return pairs.restrict_to_targets(log, _targets(spark, sf_dir)).select("file_no", "line_no", "receptor", "ligand")


D_TABLE = f"""keys as (select file_no, line_no, l_partkey, l_suppkey, line, affinity, {D_KEY.format('receptor')} as rec_key, {D_KEY.format('ligand')} as lig_key from log
    union all select file_no, line_no, l_partkey, l_suppkey, line, affinity, string_split(receptor, '/')[-1], string_split(ligand, '/')[-1] from log),
  best as (select rec_key, lig_key, affinity from (select *, row_number() over (partition by rec_key, lig_key order by file_no desc, line_no desc, l_partkey desc, l_suppkey desc, line desc) as rn from keys) where rn = 1)"""


@query(with_views("v_types", f"with {D_PARSED}, {D_TABLE} select rec_key, lig_key, affinity from best"))
def d4_affinity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.affinity_table(pairs.types_log(view(spark, sf_dir, "v_types")), LOG_ORDER)


D_PAIRS = "pairs as (select distinct case when p_partkey % 2 = 0 then 'crossdocked/P' || (p_partkey % 100) || '/r' || (p_partkey % 50) || '_rec.0' else 'x/r' || (p_partkey % 50) || '_rec_0.pdb' end as receptor, case when p_partkey % 2 = 0 then 'crossdocked/P' || (p_partkey % 100) || '/l' || (1 + p_partkey % 5) || '_lig.0' else 'x/l' || (1 + p_partkey % 5) || '_lig_0.pdb' end as ligand from part)"
_STEM = "regexp_replace(string_split({0}, '/')[-1], '[.][^.]+$', '')"
_R, _L = _STEM.format("receptor"), _STEM.format("ligand")
D_CANDIDATES = f"""candidates as (
    select receptor, ligand, 0 as pos, receptor as rec_key, ligand as lig_key from pairs union all
    select receptor, ligand, 1, string_split(receptor, '/')[-1], string_split(ligand, '/')[-1] from pairs union all
    select receptor, ligand, 2, {_R}, {_L} from pairs union all select receptor, ligand, 3, {_R} || '.pdb', {_L} || '.pdb' from pairs union all
    select receptor, ligand, 4, {_R} || '.gninatypes', {_L} || '.gninatypes' from pairs union all
    select receptor, ligand, 5, replace({_R}, '_rec', '_rec_'), replace({_L}, '_lig', '_lig_') from pairs union all
    select receptor, ligand, 6, replace(receptor, 'crossdocked/', ''), replace(ligand, 'crossdocked/', '') from pairs)"""


@query(with_views("v_types", f"with {D_PARSED}, {D_TABLE}, {D_PAIRS}, {D_CANDIDATES}, hits as (select receptor, ligand, arg_min(affinity, pos) as affinity from candidates join best using (rec_key, lig_key) group by 1, 2) select p.receptor, p.ligand, h.affinity from pairs p left join hits h using (receptor, ligand)"))
def d5_lookup_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")

    def name(head: str, number: Column, tail: str) -> Column:
        deep = F.concat(F.lit("crossdocked/P"), text(k % 100), F.lit(f"/{head}"), text(number), F.lit(f"_{tail}.0"))
        return F.when(k % 2 == 0, deep).otherwise(F.concat(F.lit(f"x/{head}"), text(number), F.lit(f"_{tail}_0.pdb")))

    wanted = table(spark, sf_dir, "part").select(name("r", k % 50, "rec").alias("receptor"), name("l", 1 + k % 5, "lig").alias("ligand")).distinct()
    return pairs.lookup_in_log(wanted, pairs.types_log(view(spark, sf_dir, "v_types")), LOG_ORDER).select("receptor", "ligand", "affinity")


@query(with_views("v_mol", f"with e as (select mol_id, list_transform({d_tokens('smiles')}, lambda t: list_position([{quoted(_VOCAB)}], t) - 1) as ids, list_filter({d_tokens('smiles')}, lambda t: list_contains([{quoted(_VOCAB)}], t)) as known from v_mol) select mol_id, array_to_string(list_filter(ids, lambda i: i is not null and i >= 0), ',') as ids, len(list_filter(ids, lambda i: coalesce(i, -1) < 0))::bigint as n_unknown, array_to_string(known, '') as decoded from e where len(ids) > 0"))
def d6_vocabulary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(t,) for t in _VOCAB[5:]], "token string")
    numbered = vocab.number_tokens(names)
    coded = vocab.encode_by_join(view(spark, sf_dir, "v_mol"), numbered, "mol_id")
    return coded.join(vocab.decode_by_join(coded, numbered, "mol_id"), "mol_id").select("mol_id", F.array_join("ids", ",").alias("ids"), "n_unknown", F.col("text").alias("decoded"))


# ---- vocabularies

D_EACH = f"each as (select mol_id, unnest({d_tokens('smiles')}) as token, generate_subscripts({d_tokens('smiles')}, 1) as pos from v_mol)"
D_NUMBERED = f"(select i::int as token_id, [{quoted(T.SPECIALS)}][i + 1] as token, true as special from range(5) r(i) union all select (4 + row_number() over (order by token))::int, token, false from chosen)"


@query(with_views("v_mol", f"with {D_EACH}, ranked as (select mol_id, token, pos from each), chosen as (select token from (select token, count(*) as n, min((mol_id, pos)) as first from ranked group by token order by n desc, first limit 20)) select * from {D_NUMBERED}"))
def e4_build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.build_vocab(view(spark, sf_dir, "v_mol"), 20)


@query(with_views("v_mol", f"with {D_EACH} select distinct token from each where mol_id in (select mol_id from v_mol order by mol_id limit 200)"))
def e5_distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.distinct_tokens(view(spark, sf_dir, "v_mol"), 200)


@query(with_views("v_mol v_seq", f"with chosen as (select distinct token from (select unnest({d_tokens('smiles')}) as token from v_mol union all select unnest({d_tokens('seq')}) from v_seq)) select * from {D_NUMBERED}"))
def h1_union_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = lambda v, c: view(spark, sf_dir, v).select(F.explode(T.tokens(F.col(c))).alias("token"))
    return vocab.union_vocab(each("v_mol", "smiles"), each("v_seq", "seq"))


# ---- order, splits, samples


@query("select min(doc_id) as doc_id, md5(text) as text_md5 from documents where text is not null group by text")
def f1_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = order.first_per_key(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")
    return first.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(with_views("v_mol", "with i as (select mol_id, row_number() over (order by mol_id) - 1 as idx, count(*) over () as n from v_mol), v as (select *, least(300, cast(floor(0.2 * n) as bigint)) as val from i) select mol_id, idx::bigint as idx, case when idx < n - val then 'train' else 'val' end as split from v"))
def f2_positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.positional_split(view(spark, sf_dir, "v_mol"), ["mol_id"], 300).select("mol_id", "idx", "split")


@query("with i as (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents) select doc_id, (idx // 100)::bigint as block, ((idx // 100) * 100 + row_number() over (partition by idx // 100 order by md5('0:' || idx), idx) - 1)::bigint as place from i")
def f3_block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.block_shuffle(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100).select("doc_id", F.col("block").cast("long").alias("block"), "place")


@query("select doc_id, ((row_number() over (order by doc_id) - 1) % 7)::int as shard from documents")
def f4a_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "shard")


@query("select doc_id, (ntile(7) over (order by doc_id) - 1)::int as shard from documents")
def f4b_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shard(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7, "range").select("doc_id", "shard")


D_UNK = f"list_transform({d_tokens('smiles')}, lambda t: case when list_contains([{quoted(_VOCAB)}], t) then list_position([{quoted(_VOCAB)}], t) - 1 else 4 end)"


@query(with_views("v_mol", f"with e as (select mol_id, (row_number() over (order by mol_id) - 1) // 32 as batch, list_concat([1], {D_UNK}, [2]) as ids from v_mol), w as (select *, least(max(len(ids)) over (partition by batch), 12) as width from e) select mol_id, batch::bigint as batch, array_to_string(list_resize(ids[:width], width, 0), ',') as ids, array_to_string(list_transform(generate_series(1, width), lambda i: (i <= len(ids))::int), ',') as mask from w"))
def f5_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select("mol_id", T.encode(T.tokens(F.col("smiles")), _VOCAB, "unk").alias("ids"))
    out = splits.pad_batches(order.with_position(mol, ["mol_id"]), "ids", 32, 12)
    return out.select("mol_id", F.col("batch").cast("long").alias("batch"), F.array_join("ids", ",").alias("ids"), F.array_join("mask", ",").alias("mask"))


@query("select l_orderkey, l_linenumber, l_suppkey, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as rn from lineitem) where rn <= 3")
def f17_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return clean.first_n(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 3)


@query("select * from (select event_id, value from events order by event_id desc limit 50) where value is not null")
def f18_tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tail_rows(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], 50, "value")


@query("select doc_id from documents order by doc_id limit 100")
def g2_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.cap(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100)


@query("select doc_id from documents where ('0x' || substr(md5('0:' || doc_id), 1, 8))::bigint::double < least(1.0, 300.0::double / (select count(*) from documents)) * 4294967296.0::double")
def g4_sample_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_to(table(spark, sf_dir, "documents").select("doc_id"), 300, "doc_id")


@query("select url as name from pages order by md5('0:' || url), url limit 20")
def g5_sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample_files(table(spark, sf_dir, "pages").select(F.col("url").alias("name")), 20)


@query(with_views("v_mol", "select smiles, min(mol_id) as first_at from v_mol group by smiles order by first_at limit 30"))
def g6_distinct_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.distinct_until(view(spark, sf_dir, "v_mol"), "smiles", "mol_id", 30)


@query(with_views("v_mol", "with i as (select smiles, row_number() over (order by mol_id) - 1 as idx from v_mol), d as (select draw, ('0x' || substr(md5('0:' || draw), 1, 8))::bigint % (select count(*) from v_mol) as idx from range(500) r(draw)) select draw::bigint as draw, smiles from d join i using (idx)"))
def g7_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.draw(view(spark, sf_dir, "v_mol").select("mol_id", "smiles"), "mol_id", 500).select("draw", "smiles")


@query(with_views("v_mol", "with v as (select mol_id, list_distinct([smiles]) as o, [smiles || 'C', 'C', smiles || 'N'][:2] as s, smiles from v_mol), a as (select mol_id, case when s[2] = smiles then [smiles, s[1]] else [smiles, s[1], s[2]] end as e from v) select mol_id, (generate_subscripts(e, 1) - 1)::int as variant_no, unnest(e) as smiles from a"))
def h3_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").withColumn("variants", F.array(F.concat("smiles", F.lit("C")), F.lit("C"), F.concat("smiles", F.lit("N"))))
    return splits.augment(mol, "mol_id", "smiles", "variants", 2)


# ---- scalar functions


@query(with_views("v_prop", "select mol_id, round(greatest(0.0, least(1.0, 1.0 - (sa - 1.0) / 9.0)), 9) as sa_norm from v_prop"))
def i9_sa_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_prop").select("mol_id", F.round(sa_norm(F.col("sa")), 9).alias("sa_norm"))


@query(with_views("v_prop", "select mol_id, round((mol_id % 4 <> 0)::int * (1.0 + 0.5 * qed + 0.3 * greatest(0.0, least(1.0, 1.0 - (sa - 1.0) / 9.0))), 9)::double as reward from v_prop"))
def i10_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = reward(F.col("mol_id") % 4 != 0, F.col("qed"), sa_norm(F.col("sa")), 1.0, 0.5, 0.3)
    return view(spark, sf_dir, "v_prop").select("mol_id", F.round(score, 9).alias("reward"))


@query(with_views("v_mol", f"with c as (select e::int as epoch, (4 + 12 * (e / 4.0::double))::double as cap from range(4) r(e)), t as (select mol_id, {d_tokens('smiles')} as t from v_mol) select epoch, count(*)::bigint as n, count(*) filter (len(t) > floor(cap))::bigint as n_cut, sum(least(len(t), floor(cap)))::bigint as tokens from c, t group by epoch"))
def i12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mol = view(spark, sf_dir, "v_mol").select("mol_id", T.tokens(F.col("smiles")).alias("ids"))
    out = splits.curriculum(mol, "mol_id", "ids", 4, 4, 16)
    return out.groupBy("epoch").agg(F.count("*").alias("n"), F.count_if("is_cut").alias("n_cut"), F.sum(F.size("ids")).alias("tokens"))


@query(with_views("v_metric", "select run_id, step, round(greatest(0.0, least(1.0, 1.0 - (step - 1) / 20.0::double)), 9) as linear, round(pow(0.95::double, step - 1), 9) as exponential, round(4.0::double / (4.0 + exp((step - 1) / 4.0::double)), 9) as sigmoid, case when step < 4 then 1.0 else round(greatest(0.1, least(1.0, 1.0 - (step - 4) / 17.0::double)), 9) end::double as warm from v_metric"))
def i13_tf_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("step") - 1
    r = lambda c: F.round(c, 9)
    return view(spark, sf_dir, "v_metric").select("run_id", "step", r(tf_prob("linear", e, 20)).alias("linear"), r(tf_prob("exponential", e, 20)).alias("exponential"), r(tf_prob("inverse_sigmoid", e, 20)).alias("sigmoid"), r(tf_prob("linear", e, 20, warmup=3, least=0.1)).alias("warm"))


@query(with_views("v_metric", "select run_id, step, round(case when step < 5 then 0.0 else least(0.5, (step - 5) / 20.0::double) end, 9) as progressive, (case when step < 5 then 0.0 else 0.5 end)::double as fixed from v_metric"))
def i14_rl_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("step")
    return view(spark, sf_dir, "v_metric").select("run_id", "step", F.round(rl_weight(e, 5), 9).alias("progressive"), rl_weight(e, 5, progressive=False).alias("fixed"))


@query(r"with u as (select page_id, regexp_replace(url, '/+$', '') as u from pages), p as (select page_id, string_split(u, '/') as s from u), n as (select page_id, s[-1] as name, coalesce(s[-2], '') as parent from p) select page_id, name, case when regexp_matches(name, '[^.][.][^.]+$') then regexp_replace(name, '[.][^.]+$', '') else name end as stem, parent, parent || '_' || case when regexp_matches(name, '[^.][.][^.]+$') then regexp_replace(name, '[.][^.]+$', '') else name end as pair_id from n")
def i15_path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", pairs.path_name(u).alias("name"), pairs.path_stem(u).alias("stem"), pairs.path_parent(u).alias("parent"), pairs.pair_id(u, u).alias("pair_id"))


@query(with_views("v_types", f"with {D_PARSED} select short, count(*)::bigint as n, round(sum(try_cast(case when short then p[2] else p[3] end as double)), 6) as affinity_sum from layouts group by short"))
def i16_types_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = pairs.types_log(view(spark, sf_dir, "v_types"))
    short = F.col("receptor") == F.element_at(F.split("line", r"\s+"), 3)
    return parsed.groupBy(short.alias("short")).agg(F.count("*").alias("n"), F.round(F.sum("affinity"), 6).alias("affinity_sum"))


@query(with_views("v_types", f"with {D_PARSED} select distinct receptor, {D_KEY.format('receptor')} as key from log"))
def i17_affinity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = pairs.types_log(view(spark, sf_dir, "v_types"))
    return log.select("receptor", pairs.affinity_key(F.col("receptor")).alias("key")).distinct()
