import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from ligature.functions.tokens import default_vocabulary
from ligature.operators import clean, ledger, pairs, plugs, vocab
from ligature.sources import readers, writers
from ligature.streaming import jobs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def column(df, name="smiles"):
    return sorted(r[name] for r in df.collect())


def test_ragged_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", "CC,1\nCO\nCN,1,2,3\n,5\nNA\n\"C,C\",1\n")
    assert column(readers.read_smiles(spark, path)) == ["C,C", "CC", "CN", "CO"]
    named = put(tmp_path / "b.csv", "id,SMILES\n1,CC\n2,\n")
    assert column(readers.read_smiles(spark, named, "SMILES")) == ["CC"]
    df, name = readers.read_table(spark, named, 1)
    assert name == "SMILES" and df.count() == 2
    four = put(tmp_path / "p.csv", "CC, MK ,5.5,p1\nCO,MK,1\nCN,MK,1,p,x\n,MK,1,p\nCF,MK,bad,p\n")
    assert sorted(map(tuple, readers.read_pairs(spark, four).collect()), key=str) == [("CC", "MK", 5.5, "p1"), ("CF", "MK", None, "p"), ("CO", "MK", 1.0, None)]
    rows = readers.read_manifest(spark, put(tmp_path / "m.csv", "protein_file,ligand_file\na,b\nc,d\n"), 1).collect()
    assert len(rows) == 1 and rows[0]["pair_id"] == "pair_0" and rows[0]["affinity"] is None
    long = put(tmp_path / "long.csv", "protein_file,ligand_file,pair_id\n" + "".join(f"a{i},b,{'own' if i == 7 else ''}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        named = {r["protein_file"]: r["pair_id"] for r in readers.read_manifest(spark, long).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert named == {f"a{i}": "own" if i == 7 else f"pair_{i}" for i in range(3000)}


def test_types_log_leaves_out_bytes_that_are_no_text(spark, tmp_path):
    for name, value in (("b.types", 2), ("a.types", 1)):
        (tmp_path / name).write_bytes(b"# c\n1 0.5 9.5 r_\xff\xferec l\n" + f"1 0.5 {value}.0 x y\n".encode())
    log = pairs.types_log(readers.read_types_log(spark, str(tmp_path / "*.types")))
    assert sorted({r["receptor"] for r in log.collect()}) == ["r_rec", "x"]
    table = pairs.affinity_table(log, readers.TYPES_ORDER)
    assert {r["affinity"] for r in table.filter("rec_key = 'x'").collect()} == {2.0}


def test_sdf_gives_every_record(spark, tmp_path):
    tags = ["PUBCHEM_OPENEYE_CAN_SMILES", "PUBCHEM_CANONICAL_SMILES"]
    text = "".join(f"m{i}\n  x\n> <{tags[i % 2]}>\n{'C' * (i + 1)}\n\n$$$$\n" for i in range(6))
    path = tmp_path / "x.sdf.gz"
    path.write_bytes(gzip.compress(text.encode()))
    assert column(readers.read_sdf_smiles(spark, str(path))) == ["C" * (i + 1) for i in range(6)]


def test_structure_files(spark, tmp_path):
    line = "{:<6}{:>5} {:<4} {:>3} {}{:>4}    {:>8.3f}{:>8.3f}{:>8.3f}  1.00  0.00          {:>2}\n"
    text = line.format("ATOM", 1, "CA", "ALA", "A", 12, 1.5, -2.25, 3, "C") + line.format("ATOM", 2, "H", "ALA", "A", 12, 1, 2, 3, "H") + line.format("HETATM", 3, "O", "HOH", "B", 7, 0, 0, 0, "O") + "END\n"
    put(tmp_path / "p/x_rec.pdb", text)
    rows = sorted(readers.read_pdb_atoms(spark, str(tmp_path / "p")).collect(), key=lambda r: r["resnum"])
    assert [(r["chain"], r["resnum"], r["resname"], r["x"], r["y"]) for r in rows] == [("B", 7, "HOH", 0.0, 0.0), ("A", 12, "ALA", 1.5, -2.25)]
    archive = tmp_path / "a.tgz"
    with tarfile.open(archive, "w:gz") as tar:
        for name in ("crossdocked/P/x_rec.pdb", "crossdocked/P/y_lig.pdb", "crossdocked/P/z.txt", "other/x_rec.pdb"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    found = readers.list_tar_members(spark, str(archive))
    assert sorted((r["pocket"], r["file"], r["kind"]) for r in found.collect()) == [("P", "x_rec.pdb", "rec"), ("P", "y_lig.pdb", "lig")]
    some = readers.read_tar_members(spark, str(archive), found.filter("kind = 'lig'")).collect()
    assert [(r["member"], bytes(r["content"])) for r in some] == [("crossdocked/P/y_lig.pdb", b"abc")]
    # as an archive too large for a cell: opened where it lies, read in a stream
    far = readers.list_tar_members(spark, str(archive), stream_bytes=0)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, found.collect()))
    some = readers.read_tar_members(spark, str(archive), far.filter("kind = 'lig'"), stream_bytes=0).collect()
    assert [(r["member"], bytes(r["content"])) for r in some] == [("crossdocked/P/y_lig.pdb", b"abc")]
    listing = readers.list_files(spark, str(tmp_path / "p"))
    assert listing.count() == 1 and readers.total_bytes(listing).first()["bytes"] == len(text)
    path = listing.first()["path"]
    both = spark.createDataFrame([(path, path), (path, "no")], "protein_file string, ligand_file string")
    assert readers.existing_pairs(both, listing).count() == 1


def test_checksums_and_companions(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string")
    sums = spark.createDataFrame([("a", "9DD4E461268C8034F5C8564E155C67A6  a"), ("b", "0  b")], "name string, line string")
    assert column(readers.verified_files(files, sums), "name") == ["a"]
    names = spark.createDataFrame([("x.gz",), ("x.gz.md5",), ("y.gz",)], "name string")
    assert column(readers.paired_listing(names), "name") == ["x.gz"]


def test_vocabulary_metrics_and_samples(spark, tmp_path):
    numbered = vocab.number_tokens(spark.createDataFrame([(t,) for t in default_vocabulary()[5:]], "token string"))
    writers.write_vocab(numbered, str(tmp_path / "v"))
    body = json.loads("".join(p.read_text() for p in (tmp_path / "v").glob("part*")))
    assert body["size"] == 90 and body["vocabulary"] == default_vocabulary()
    back = readers.read_vocab(spark, str(tmp_path / "v")).orderBy("token_id").collect()
    assert [r["token"] for r in back] == default_vocabulary() and sum(r["special"] for r in back) == 5
    one = spark.createDataFrame([(1, 2.0)], "epoch int, loss double")
    writers.append_metrics(one, str(tmp_path / "m"))
    writers.append_metrics(one.withColumn("rl", F.lit(3)), str(tmp_path / "m"))
    assert sorted((r["epoch"], r["rl"] or 0) for r in readers.read_metrics(spark, str(tmp_path / "m")).collect()) == [(1, 0), (1, 3)]
    df = spark.createDataFrame([(2, "CO", True), (1, "CC", False)], "n int, smiles string, is_valid boolean")
    writers.write_samples(df, str(tmp_path / "generated_phase2_ep003.txt"))
    got = [tuple(r) for r in readers.read_samples(spark, str(tmp_path / "generated_phase2_ep003.txt")).orderBy("n").collect()]
    assert got == [(2, 3, 1, "CC"), (2, 3, 2, "CO")]
    writers.write_summary(df, str(tmp_path / "s"), "MKT")
    body = json.loads("".join(p.read_text() for p in (tmp_path / "s").glob("part*")))
    assert body["summary"] == {"total": 2, "num_valid": 1} and body["valid"] == ["CO"] and body["length"] == 3
    many = spark.createDataFrame([(i, f"C{i}", None if i == 7 else i % 3 == 0) for i in range(3000)], "n int, smiles string, is_valid boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small become one file
    try:
        writers.write_summary_lists(many, str(tmp_path / "w"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "w").glob("is_valid=*/part*"))
    at = {f: [json.loads(x)["n"] for x in f.read_text().splitlines()] for f in files}
    assert len(files) > 2 and all(x == sorted(x) for x in at.values())
    lists = {v: sorted(n for f, x in at.items() if f.parent.name == f"is_valid={v}" for n in x) for v in ("true", "false")}
    assert lists == {"true": list(range(0, 3000, 3)), "false": [i for i in range(3000) if i % 3]}


def test_tables_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, "CCO", "a,b"), (2, "CC", "c"), (3, "CCO", "d")], "mol_id int, smiles string, note string")
    judged = clean.with_clean_verdict(df)
    writers.write_clean(judged, str(tmp_path / "c"), header=True)
    assert sorted(r["note"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["a,b", "d"]
    writers.write_lines(df, str(tmp_path / "l"))
    assert column(spark.read.text(str(tmp_path / "l")), "value") == ["CC", "CCO", "CCO"]
    pairs = spark.createDataFrame([("CC", "MK", 1.5)], "smiles string, pocket_sequence string, affinity double")
    writers.write_pairs(pairs, str(tmp_path / "p"))
    assert readers.read_pairs(spark, str(tmp_path / "p")).first()["affinity"] == 1.5
    writers.write_table(pairs, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == pairs.columns
    ledger.write_ledger(plugs.convert_with_ledger(df), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/converted")).count() == 2
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "g/failed")).first()["Reason"] == "Duplicate SMILES"


def test_streams_resume(spark, tmp_path):
    put(tmp_path / "in/a.txt", "CCO\nCCN\nCCO\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: jobs.ingest(jobs.unique_strings(jobs.stream_lines(spark, str(tmp_path / "in"))), out, mark).awaitTermination(60)
    run()
    assert column(spark.read.parquet(out)) == ["CCN", "CCO"]
    put(tmp_path / "in/b.txt", "CCO\nCCF\n")
    run()
    assert column(spark.read.parquet(out)) == ["CCF", "CCN", "CCO"]
    ready = jobs.clean_and_tokenise(jobs.stream_lines(spark, str(tmp_path / "in")), default_vocabulary())
    jobs.ingest(ready, str(tmp_path / "ids"), str(tmp_path / "mark2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "ids")).count() == 5


def test_stream_throughput_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, v int"
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    for k, minutes in enumerate(([0, 1, 30], [2, 31, 60], [1, 90])):
        spark.createDataFrame([(day + dt.timedelta(minutes=m), 1) for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    seen = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    jobs.for_each_batch(jobs.throughput(source, "ts", "10 minutes", "20 minutes"), lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "m")).awaitTermination(90)
    counts = {t.hour * 60 + t.minute: n for t, n in seen}
    # minute 2 comes while the watermark of the batch before is 0, minute 1 when it is 10 and its interval closed; 90 is still open
    assert counts == {0: 3, 30: 2, 60: 1}


def test_live_alarms(spark, tmp_path):
    rows = [(1, i, 1e-9 if i > 70 else 1.0 / (i + 1), 20.0 if i == 60 else 1.0) for i in range(90)]
    spark.createDataFrame(rows, "run_id long, step long, loss double, grad_norm double").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema("run_id long, step long, loss double, grad_norm double").parquet(str(tmp_path / "in"))
    jobs.for_each_batch(jobs.alarms(source), lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "m")).awaitTermination(90)
    steps = lambda name: sorted(r[1] for r in seen if r[3] == name)
    assert steps("exploding_gradients") == list(range(60, 70)) and steps("numerical_instability") == list(range(80, 90))
