"""Queries that go through files and streams: rows of the tables are written in each format by Spark, with the odd lines that
the formats know, and read back by the library."""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, ledger, plugs, vocab
from ..operators.scan import shared_folder
from ..sources import readers, writers
from ..streaming import jobs, ordered, sinks
from .measures import rounded
from .molecules import _VOCAB, d_tokens, quoted
from .registry import ORACLES, query, table
from .tables import D_NUMBERED
from .views import view, with_views


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def lines(df: DataFrame, line: str, name: str) -> str:
    """The path of text files with one line for each row."""
    path = scratch(df.sparkSession, name)
    df.selectExpr(f"{line} as value").write.text(path)
    return path


# ---- sources

_RAGGED = "case when mol_id % 7 = 0 then ',x' when mol_id % 7 = 1 then 'NA,1' else smiles || repeat(',1', cast(mol_id % 3 as int)) end"


@query(with_views("v_mol", "select smiles from v_mol where mol_id % 7 > 1"))
def a1_read_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_smiles(spark, lines(view(spark, sf_dir, "v_mol"), _RAGGED, "ragged"))


@query(with_views("v_mol", "select mol_id::varchar as mol_id, smiles as by_place, source from v_mol"))
def a2_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "table")
    writers.write_table(view(spark, sf_dir, "v_mol"), path)
    rows, name = readers.read_table(spark, path, 1)
    return rows.withColumnRenamed(name, "by_place")


@query(with_views("v_mol", "select smiles from v_mol where mol_id % 5 <> 0"))
def a3_read_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "named")
    mol = view(spark, sf_dir, "v_mol")
    writers.write_table(mol.select("source", F.when(F.col("mol_id") % 5 != 0, F.col("smiles")).alias("SMILES")), path)
    return readers.read_smiles(spark, path, "SMILES")


_PAIR = "case cast(mol_id % 5 as int) when 0 then smiles || ',' || source when 1 then smiles || ' , ' || source || ',' || cast(mol_id as string) || '.5' when 2 then ',' || source || ',1,p' when 3 then smiles || ',' || source || ',1,p,more' else smiles || ',' || source || ',bad,p' || cast(mol_id as string) end"


@query(with_views("v_mol", "select smiles, source as pocket_sequence, case when mol_id % 5 = 1 then mol_id + 0.5::double end as affinity, case when mol_id % 5 = 4 then 'p' || mol_id end as pair_id from v_mol where mol_id % 5 in (0, 1, 4)"))
def a4_read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_pairs(spark, lines(view(spark, sf_dir, "v_mol"), _PAIR, "pairs"))


@query(with_views("v_mol", "select smiles as protein_file, source as ligand_file, 'p' || mol_id as pair_id, case when mol_id % 2 = 0 then mol_id::double end as affinity from v_mol"))
def a5_read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "manifest")
    rows = view(spark, sf_dir, "v_mol").selectExpr("smiles as protein_file", "source as ligand_file", "'p' || mol_id as pair_id", "if(mol_id % 2 = 0, cast(mol_id as string), 'none') as affinity")
    writers.write_table(rows, path)
    return readers.read_manifest(spark, path)


@query(with_views("v_mol", "select smiles from v_mol"))
def a8_read_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sdf")
    tag = F.when(F.col("mol_id") % 2 == 0, "PUBCHEM_OPENEYE_CAN_SMILES").otherwise("PUBCHEM_CANONICAL_SMILES")
    record = F.concat(F.col("mol_id").cast("string"), F.lit("\n  x\n\n> <"), tag, F.lit(">\n"), F.col("smiles"), F.lit("\n\n"))
    view(spark, sf_dir, "v_mol").select(record).write.option("lineSep", "$$$$\n").option("compression", "gzip").text(path)
    return readers.read_sdf_smiles(spark, path)


@query(with_views("v_atom", "select chain, resnum, resname, 'C' as element, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from v_atom where atom_id % 4 <> 0"))
def a9_read_pdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pdb")
    kind, element = F.when(F.col("atom_id") % 3 == 0, "HETATM").otherwise("ATOM"), F.when(F.col("atom_id") % 4 == 0, "H").otherwise("C")
    place = [F.round(c, 3) for c in ("x", "y", "z")]
    atom = F.format_string("%-6s%5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", kind, F.col("atom_id") % 100000, F.lit("CA"), "resname", "chain", "resnum", *place, element)
    view(spark, sf_dir, "v_atom").select(atom).unionByName(spark.range(1).select(F.lit("END").alias("x")).toDF(*view(spark, sf_dir, "v_atom").select(atom).columns)).write.text(path)
    return readers.read_pdb_atoms(spark, path).drop("file")


def _tree(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folders by brand with the molecules of even ids."""
    path = scratch(spark, name)
    mol = view(spark, sf_dir, "v_mol").filter("mol_id % 2 = 0")
    mol.select("smiles", F.replace("source", F.lit("#"), F.lit("_")).alias("brand")).write.partitionBy("brand").text(path)
    return path


_BRAND = "regexp_extract(path, 'brand=([^/]*)/', 1)"


@query(with_views("v_mol", "select distinct replace(source, '#', '_') as brand from v_mol where mol_id % 2 = 0"))
def a12_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.list_files(spark, _tree(spark, sf_dir, "tree")).select(F.expr(_BRAND).alias("brand")).distinct()


@query(with_views("v_mol", "select coalesce(sum(strlen(smiles) + 1), 0)::bigint as bytes from v_mol where mol_id % 2 = 0"))
def e16_total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.total_bytes(readers.list_files(spark, _tree(spark, sf_dir, "sizes")))


@query(with_views("v_mol", "with b as (select distinct replace(source, '#', '_') as b from v_mol where mol_id % 2 = 0), p as (select mol_id, replace(source, '#', '_') as protein_file, 'Brand_' || (mol_id % 60) as ligand_file from v_mol) select * from p where protein_file in (select b from b) and ligand_file in (select b from b)"))
def c13_existing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = readers.list_files(spark, _tree(spark, sf_dir, "pairs")).select(F.expr(_BRAND).alias("path"))
    pairs = view(spark, sf_dir, "v_mol").selectExpr("mol_id", "replace(source, '#', '_') as protein_file", "'Brand_' || (mol_id % 60) as ligand_file")
    return readers.existing_pairs(pairs, listing)


#: Bytes of content after which the next archive begins.
ARCHIVE_BYTES = 32 << 20


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """Tar archives, every other one gzipped, with a member for each page. A task writes the pages it gets one by one, into
    as many archives as they need, so it holds a batch and not an archive."""
    path = scratch(spark, "archives")
    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    store.create_dir(place)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, part, held, written = TaskContext.get().partitionId(), None, 0, 0, 0
        store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        with ExitStack() as opened:
            for batch in batches:
                for archive, name, html in zip(*(batch.column(c) for c in ("archive", "member", "html"))):
                    if archive.as_py() != now or held >= ARCHIVE_BYTES:
                        opened.close()
                        now, part, held = archive.as_py(), part + 1, 0
                        raw = opened.enter_context(store.open_output_stream(f"{place}/{now}-{task}-{part}.tar", compression="gzip" if now % 2 else None))
                        tar = opened.enter_context(tarfile.open(fileobj=raw, mode="w|"))
                    info = tarfile.TarInfo(name.as_py())
                    info.size = len(content := (html.as_py() or "").encode())
                    tar.addfile(info, io.BytesIO(content))
                    tar.members = []  # it would keep all of them
                    held, written = held + info.size, written + 1
        yield pa.RecordBatch.from_pydict({"n": [written]})

    rows = table(spark, sf_dir, "pages").selectExpr("page_id % 6 as archive", f"{_MEMBER} as member", "html", "page_id")
    dealt = rows.repartition("page_id").sortWithinPartitions("archive", "page_id").select("archive", "member", "html")
    dealt.mapInArrow(pack, "n long").agg(F.sum("n")).collect()  # one row
    return path


_MEMBER = "case when page_id % 4 = 3 then 'other/' else 'crossdocked/' end || 'P' || cast(page_id % 10 as string) || '/' || cast(page_id as string) || case when page_id % 2 = 0 then '_rec.pdb' when page_id % 5 = 0 then '.txt' else '_lig.pdb' end"
_D_MEMBER = f"m as (select *, {_MEMBER} as member from pages)"


@query(f"with {_D_MEMBER} select member, strlen(coalesce(html, ''))::bigint as size, 'P' || page_id % 10 as pocket, string_split(member, '/')[3] as file, case when page_id % 2 = 0 then 'rec' else 'lig' end as kind from m where page_id % 4 <> 3 and (page_id % 2 = 0 or page_id % 5 <> 0)")
def a10_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.list_tar_members(spark, _archives(spark, sf_dir), stream_bytes=0).drop("archive")


@query(f"with {_D_MEMBER} select member, md5(coalesce(html, '')) as digest from m where page_id % 4 <> 3 and page_id % 2 = 1 and page_id % 5 <> 0")
def a11_read_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _archives(spark, sf_dir)
    wanted = readers.list_tar_members(spark, path).filter("kind = 'lig'")
    return readers.read_tar_members(spark, path, wanted, stream_bytes=0, split_bytes=1 << 20).select("member", F.md5("content").alias("digest"))


@query(f"with {_D_MEMBER} select member, unnest(range(len(string_split(coalesce(html, ''), '<p>')))) as part, unnest(list_transform(string_split(coalesce(html, ''), '<p>'), lambda x: strlen(x))) as size from m where page_id % 4 = 0")
def k5_archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parts(member: str, content: bytes) -> Iterator[tuple]:
        for k, x in enumerate(content.split(b"<p>")):
            yield member, k, len(x)

    wanted = table(spark, sf_dir, "pages").filter("page_id % 4 = 0").selectExpr(f"{_MEMBER} as member")
    return readers.parse_tar_members(spark, _archives(spark, sf_dir), wanted, parts, "member string, part long, size long")


@query(with_views("v_mol", f"with chosen as (select distinct unnest({d_tokens('smiles')}) as token from v_mol) select * from {D_NUMBERED}"))
def a14_vocab_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "vocab")
    writers.write_vocab(vocab.number_tokens(vocab.distinct_tokens(view(spark, sf_dir, "v_mol"), 0)), path)
    return readers.read_vocab(spark, path)


@query(with_views("v_metric", "select run_id, step, loss, case when run_id % 2 = 0 then step * 2 end::bigint as train_avg_qed from v_metric"))
def a16_metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    rows = view(spark, sf_dir, "v_metric").select("run_id", "step", "loss")
    writers.append_metrics(rows.filter("run_id % 2 = 1"), path)
    writers.append_metrics(rows.filter("run_id % 2 = 0").withColumn("train_avg_qed", F.col("step") * 2), path)
    return readers.read_metrics(spark, path).select("run_id", F.col("step").cast("int").alias("step"), "loss", "train_avg_qed")


@query(with_views("v_mol", "select 1::int as phase, 2::int as epoch, mol_id::int as n, smiles from v_mol"))
def a17_samples_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "generated_phase1_ep002.txt")
    writers.write_samples(view(spark, sf_dir, "v_mol"), path, "mol_id")
    return readers.read_samples(spark, path)


# ---- sinks


@query(with_views("v_mol v_prop", "select smiles, source as pocket_sequence, qed as affinity from v_mol join v_prop using (mol_id)"))
def b1_write_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pairs")
    rows = view(spark, sf_dir, "v_mol").join(view(spark, sf_dir, "v_prop"), "mol_id")
    writers.write_pairs(rows.select("smiles", F.col("source").alias("pocket_sequence"), F.col("qed").alias("affinity")), path)
    return readers.read_pairs(spark, path).drop("pair_id")


@query("select p_name as name, p_brand || ', \"' || p_partkey || '\"' as note from part")
def b2_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "quoted")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_name as name", "p_brand || ', \"' || p_partkey || '\"' as note")
    writers.write_table(rows, path)
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query(with_views("v_mol", "select smiles as value from v_mol"))
def b3_write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    writers.write_lines(view(spark, sf_dir, "v_mol"), path)
    return spark.read.text(path)


@query(f"select mol_id::varchar as mol_id, smiles from ({ORACLES['c1_clean_verdict']}) where is_valid")
def b5_write_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "clean")
    writers.write_clean(clean.with_clean_verdict(view(spark, sf_dir, "v_mol").select("mol_id", "smiles")), path, header=True)
    return spark.read.option("header", True).csv(path)


@query(with_views("v_mol", "with f as (select *, not contains(smiles, '>') as ok from v_mol order by mol_id limit 1000) select 'MKT' as sequence, 3::bigint as length, (select count(*) from v_mol)::bigint as total, (select count(*) from v_mol where not contains(smiles, '>'))::bigint as num_valid, (select string_agg(smiles, ' ' order by mol_id) from f where ok) as valid, (select string_agg(smiles, ' ' order by mol_id) from f where not ok) as invalid"))
def b8_write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "summary")
    mol = view(spark, sf_dir, "v_mol").select(F.col("mol_id").alias("n"), "smiles", (~F.col("smiles").contains(">")).alias("is_valid"))
    writers.write_summary(mol, path, "MKT")
    back = spark.read.schema("sequence string, length long, summary struct<total long, num_valid long>, valid array<string>, invalid array<string>").json(path)
    return back.select("sequence", "length", "summary.total", "summary.num_valid", F.array_join("valid", " ").alias("valid"), F.array_join("invalid", " ").alias("invalid"))


@query(with_views("v_mol", "select mol_id::bigint as n, smiles, not contains(smiles, '>') as is_valid from v_mol"))
def b8_summary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "summary-lists")
    writers.write_summary_lists(view(spark, sf_dir, "v_mol").select(F.col("mol_id").alias("n"), "smiles", (~F.col("smiles").contains(">")).alias("is_valid")), path)
    return spark.read.schema("n long, smiles string, is_valid boolean").json(path)


_KEYED = f"keyed as (select mol_id, smiles, array_to_string({d_tokens('smiles')}, '') as key from v_mol), judged as (select *, case when key = '' then 'conversion_failed' when row_number() over (partition by key order by mol_id) > 1 then 'Duplicate SMILES' else 'ok' end as outcome from keyed)"


@query(with_views("v_mol", f"with {_KEYED} select smiles, outcome from judged where outcome <> 'ok' union all select smiles, outcome from judged where outcome = 'ok'"))
def b4_write_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ledger")
    ledger.write_ledger(plugs.convert_with_ledger(view(spark, sf_dir, "v_mol").select("mol_id", "smiles")), folder)
    failed = spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/failed").select("smiles", F.col("Reason").alias("outcome"))
    return failed.unionByName(spark.read.option("header", True).csv(f"{folder}/converted").select("smiles", F.lit("ok").alias("outcome")))


# ---- streams


def _halves(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[DataFrame]]:
    mol = view(spark, sf_dir, "v_mol")
    return scratch(spark, name), [mol.filter("mol_id % 2 = 0"), mol.filter("mol_id % 2 = 1")]


@query(with_views("v_mol", f"with {_KEYED} select outcome, count(*)::bigint as n from judged group by outcome"))
def b4_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, from a stream that is started twice."""
    folder, halves = _halves(spark, sf_dir, "ledger-stream")
    handle = sinks.write_ledger_batches(f"{folder}/out")
    for half in halves:
        half.select("mol_id", "smiles").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("mol_id long, smiles string").parquet(f"{folder}/in")
        sinks.run_sink(source, handle, f"{folder}/mark").awaitTermination()
    stats = spark.read.json(f"{folder}/out/stats").select("outcome", "n", "batch")
    return stats.join(F.broadcast(stats.agg(F.max("batch").alias("batch"))), "batch").select("outcome", "n")  # one row


@query(with_views("v_mol", "select smiles from v_mol"))
def j1_resumable_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, halves = _halves(spark, sf_dir, "ingest")
    for half in halves:
        half.select("smiles").write.mode("append").text(f"{folder}/in")
        jobs.ingest(jobs.stream_lines(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(with_views("v_mol", "select distinct smiles from v_mol"))
def j2_unique_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, halves = _halves(spark, sf_dir, "unique")
    for half in halves:
        half.select("smiles").write.mode("append").text(f"{folder}/in")
        sinks.run_sink(jobs.stream_lines(spark, f"{folder}/in"), sinks.write_once(f"{folder}/out"), f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("smiles")


@query(f"with judged as ({ORACLES['f14_stability']}), named as (select run_id, step, steps_since_best, unnest(['numerical_instability', 'exploding_gradients', 'non_finite_loss', 'complete_stagnation']) as alarm, unnest([numerical_instability, exploding_gradients, non_finite_loss, complete_stagnation]) as hit from judged) select run_id::bigint as run_id, step::bigint as step, steps_since_best, alarm from named where hit")
def j4_ordered_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's rows come as one batch in any order; a row of another run an hour later lets the watermark pass them."""
    folder = scratch(spark, "alarms")
    rows = view(spark, sf_dir, "v_metric").select("run_id", "step", "loss", "grad_norm", F.col("ts").cast("timestamp").alias("ts"))
    last = rows.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts")).selectExpr("-1L as run_id", "1 as step", "0D as loss", "0D as grad_norm", "ts")
    rows.unionByName(last.withColumn("run_id", F.col("run_id").cast(rows.schema["run_id"].dataType))).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    alarms = ordered.ordered_alarms(source, "ts", "10 minutes", idle="40 days", patience=30, warm=20, span=10 * 86_400_000)
    jobs.ingest(alarms, f"{folder}/out", f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"with c as ({ORACLES['c1_clean_verdict']}), e as (select smiles, list_transform({d_tokens('smiles')}, lambda t: list_position([{quoted(_VOCAB)}], t) - 1) as ids from c where is_valid) select smiles, array_to_string(list_concat(list_concat([1], ids), [2]), ',') as ids from e where len(list_filter(ids, lambda i: coalesce(i, -1) < 0)) = 0")
def j5_clean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, halves = _halves(spark, sf_dir, "clean-stream")
    for half in halves:
        half.select("smiles").write.mode("append").text(f"{folder}/in")
        jobs.ingest(jobs.clean_and_tokenise(jobs.stream_lines(spark, f"{folder}/in"), _VOCAB), f"{folder}/out", f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("smiles", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


# ---- plugs


def _upper(text: pd.Series) -> pd.DataFrame:
    key = text.str.upper().str.replace(r"[^A-Z]", "", regex=True)
    return pd.DataFrame({"processed": text, "converted": key, "error": key.map(lambda k: None if len(k) > 1 else "too_short")})


@query(with_views("v_mol", "with k as (select mol_id, smiles, regexp_replace(upper(smiles), '[^A-Z]', '', 'g') as converted from v_mol) select mol_id, smiles as processed, converted, case when length(converted) <= 1 then 'too_short' when row_number() over (partition by converted order by mol_id) > 1 then 'Duplicate SMILES' else 'ok' end as outcome from k"))
def k1_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugs.convert_with_ledger(view(spark, sf_dir, "v_mol").select("mol_id", "smiles"), _upper).select("mol_id", "processed", "converted", "outcome")


@query(with_views("v_mol", "select mol_id, length(smiles)::bigint as atoms, round(length(replace(smiles, 'C', ''))::double / length(smiles), 6) as hetero from v_mol"))
def k3_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    def properties(text: pd.Series) -> pd.DataFrame:
        size = text.str.len()
        return pd.DataFrame({"atoms": size, "hetero": text.str.replace("C", "").str.len() / size})

    known = plugs.property_plug(properties, "atoms long, hetero double")
    return rounded(view(spark, sf_dir, "v_mol").select("mol_id", known(F.col("smiles")).alias("p")).select("mol_id", "p.*"))


def _counted(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mw": text.str.len() * 60.0, "logp": text.str.count("C") * 1.0, "hbd": text.str.count("N"), "hba": text.str.count("O") + text.str.count("N")})


_KNOWN = "known as (select smiles, mw, logp, hbd, hba from (select smiles, p.*, row_number() over (partition by smiles order by mw, logp, hbd, hba) as r from v_mol join v_prop p using (mol_id) where not contains(smiles, 'C')) where r = 1)"
_MADE = "made as (select distinct smiles, length(smiles) * 60.0::double as mw, (length(smiles) - length(replace(smiles, 'C', '')))::double as logp, length(smiles) - length(replace(smiles, 'N', '')) as hbd, 2 * length(smiles) - length(replace(smiles, 'O', '')) - length(replace(smiles, 'N', '')) as hba from v_mol where contains(smiles, 'C'))"


@query(with_views("v_mol v_prop", f"with {_KNOWN}, {_MADE}, p as (select * from known union all select * from made) select mol_id, round(mw, 6) as mw, round(logp, 6) as logp, hbd::bigint as hbd, hba::bigint as hba, ((mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int)::int as lipinski_violations, (mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int <= 1 as is_drug_like from v_mol join p using (smiles)"))
def k3_known_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property table for the strings without carbon, the plug for the others, and the rule of five on both."""
    mol = view(spark, sf_dir, "v_mol").select("mol_id", "smiles")
    known = mol.join(view(spark, sf_dir, "v_prop"), "mol_id").filter(~F.col("smiles").contains("C")).drop("mol_id")
    both = plugs.with_properties(mol, _counted, "mw double, logp double, hbd long, hba long", known=known)
    return rounded(clean.rule_of_five(both.select("mol_id", "properties.*")))


@query(with_views("v_mol", "select mol_id, not contains(smiles, '(') or contains(smiles, ')') as is_valid from v_mol"))
def k4_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = plugs.validity(F.col("smiles"), lambda s: ~s.str.contains("(", regex=False) | s.str.contains(")", regex=False))
    return view(spark, sf_dir, "v_mol").select("mol_id", word.alias("is_valid"))
