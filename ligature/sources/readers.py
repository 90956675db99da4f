"""Readers of ragged text, Parquet, structure files, archives, logs and vocabularies."""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import SPECIALS
from ..operators.order import with_position
from .archives import BATCH_BYTES, SPLIT_BYTES, parsed_members, read_indexed, tar_index

#: Strings that count as missing in CSV cells.
MISSING = ["", "NA", "N/A", "null", "NULL", "NaN", "nan", "None"]


#: The order of the lines of read_types_log(), in which the last of a key wins.
TYPES_ORDER = ["file", "block", "line_no"]
#: Archives above this many bytes are read where they lie by ranges, others through Spark's reader.
STREAM_BYTES = SPLIT_BYTES


def _missing(c: Column) -> Column:
    return F.when(~c.isin(MISSING), c)


def read_smiles(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """(smiles): the first field of each line of headerless CSV, or a named column; missing cells go, rows of any
    length stay."""
    if column:
        raw = spark.read.option("header", True).csv(path).select(F.col(column).alias("smiles"))
    else:
        raw = spark.read.text(path).select(F.from_csv("value", F.lit("smiles string"))["smiles"].alias("smiles"))
    return raw.select(_missing(F.col("smiles")).alias("smiles")).filter("smiles is not null")


def read_table(spark: SparkSession, path: str, smiles_column: int = 0, has_header: bool = True) -> tuple[DataFrame, str]:
    """The whole rows, and the name of the column at that place."""
    df = spark.read.option("header", has_header).csv(path)
    return df, df.columns[smiles_column]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(smiles, pocket_sequence, affinity, pair_id) of headerless CSV: short rows get nulls, rows with too many
    fields go, strings are trimmed, rows without either string go."""
    fields = F.from_csv("value", F.lit("a string, b string, c string, d string, rest string"))
    rows = spark.read.text(path).filter("trim(value) <> ''").select(fields.alias("f")).filter("f.rest is null")
    cell = lambda c: _missing(F.trim(F.col(f"f.{c}")))
    out = rows.select(cell("a").alias("smiles"), cell("b").alias("pocket_sequence"), cell("c").try_cast("double").alias("affinity"), cell("d").alias("pair_id"))
    return out.filter("smiles is not null and pocket_sequence is not null")


def read_manifest(spark: SparkSession, path: str, max_pairs: int = 0) -> DataFrame:
    """(protein_file, ligand_file, pair_id, affinity) from CSV with a header; the last two are optional, and a pair
    without an id is named by the number of its row."""
    df = spark.read.option("header", True).csv(path)
    df = df.limit(max_pairs) if max_pairs else df
    if "pair_id" not in df.columns or df.filter("pair_id is null").limit(1).count():
        df = with_position(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "_number")
    else:
        df = df.withColumn("_number", F.lit(0))
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    default = F.concat(F.lit("pair_"), F.col("_number").cast("string"))
    return df.select("protein_file", "ligand_file", F.coalesce(given("pair_id"), default).alias("pair_id"), given("affinity").try_cast("double").alias("affinity"))


def read_parquet_smiles(spark: SparkSession, path: str, column: str = "smiles") -> DataFrame:
    return spark.read.parquet(path).select(F.col(column).alias("smiles"))


def table_rows(df: DataFrame) -> DataFrame:
    """(n): no column is read, so Parquet answers from its footers."""
    return df.select().agg(F.count(F.lit(1)).alias("n"))


def read_sdf_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(smiles) of every record of SDF files, plain or gzipped, from the line after either of the string tags."""
    records = spark.read.option("lineSep", "$$$$\n").text(path)
    found = F.regexp_extract("value", r"PUBCHEM_(?:OPENEYE_CAN|CANONICAL)_SMILES>[^\n]*\n([^\n]+)", 1)
    return records.select(F.trim(found).alias("smiles")).filter("smiles <> ''")


def read_pdb_atoms(spark: SparkSession, path: str, drop_hydrogen: bool = True) -> DataFrame:
    """(file, chain, resnum, resname, element, x, y, z) of atom lines, by their fixed columns."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    element = F.when(cut(77, 2) != "", cut(77, 2)).otherwise(F.regexp_extract(cut(13, 4), "^[0-9]*([A-Za-z])", 1))
    atoms = lines.select("file", cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resnum"), cut(18, 3).alias("resname"), element.alias("element"), *[cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))])
    atoms = atoms.dropna(subset=["resnum", "x", "y", "z"])
    return atoms.filter("upper(element) <> 'H'") if drop_hydrogen else atoms


def _archives(spark: SparkSession, path: str, stream_bytes: int) -> tuple[DataFrame, list[str], int]:
    """The small archives with their bytes, and the paths and the size of the large ones, from their listing."""
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > stream_bytes).select("path", "length").collect()  # names of files, as Spark's own listing
    return files.filter(F.col("length") <= stream_bytes).select("path", "content"), [r["path"] for r in large], sum(r["length"] for r in large)


def _small_index(small: DataFrame, content: bool) -> DataFrame:
    """(archive, member, size), or with ``content`` that too, of archives that came as bytes, many members a batch."""
    last = pa.field("content", pa.binary()) if content else pa.field("size", pa.int64())
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive, whole in zip(batch.column("path"), batch.column("content")):
                with tarfile.open(fileobj=pa.BufferReader(whole.as_buffer()), mode="r:*") as tar:
                    while (info := tar.next()) is not None:
                        tar.members = []  # it would keep all of them
                        if info.isfile():
                            rows.append((archive.as_py(), info.name, tar.extractfile(info).read() if content else info.size))
                            held += info.size if content else 0
                            if held >= BATCH_BYTES or len(rows) == 10000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return small.mapInArrow(run, f"archive string, member string, {'content binary' if content else 'size long'}")


def list_tar_members(spark: SparkSession, path: str, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """(archive, member, size, pocket, file, kind) of structure files in archives, a task an archive. Of an archive above
    ``stream_bytes`` only the headers are read, and the test on the first folder runs in the walk."""
    small, large, _ = _archives(spark, path, stream_bytes)
    found = _small_index(small, False).unionByName(tar_index(spark, large).select("archive", "member", "size")).filter(F.col("member").startswith("crossdocked/"))
    parts = found.withColumn("p", F.split("member", "/")).filter("size(p) = 3")
    kind = F.when(F.col("member").endswith("_rec.pdb"), "rec").when(F.col("member").endswith("_lig.pdb"), "lig")
    return parts.select("archive", "member", "size", F.col("p")[1].alias("pocket"), F.col("p")[2].alias("file"), kind.alias("kind")).filter("kind is not null")


def read_tar_members(spark: SparkSession, path: str, wanted: DataFrame, stream_bytes: int = STREAM_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(member, content) of the wanted members (member); a name that an archive has twice comes twice.

    Archives above ``stream_bytes`` are joined by their index, so only wanted contents are read, ``split_bytes`` of an
    archive a task; smaller ones come through Spark's reader, from any store, and are joined after."""
    small, large, size = _archives(spark, path, stream_bytes)
    names = wanted.select("member").distinct()
    near = _small_index(small, True).join(names, "member", "left_semi")
    far = read_indexed(tar_index(spark, large).join(names, "member", "left_semi"), size, split_bytes)
    return near.select("member", "content").unionByName(far.select("member", "content"))


def parse_tar_members(spark: SparkSession, path: str, wanted: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each wanted member, in the task that reads it."""
    return parsed_members(read_tar_members(spark, path, wanted), parse, schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of files; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def total_bytes(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def existing_pairs(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Pairs of which both files are in the listing (path)."""
    for c in ("protein_file", "ligand_file"):
        pairs = pairs.join(listing.select(F.col("path").alias(c)).distinct(), c, "left_semi")
    return pairs


def read_types_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line) of log files, in the order TYPES_ORDER: files by name, their splits by place, lines
    within a split. Bytes that are no UTF-8 are left out."""
    line = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), line.alias("line"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token, special) of a vocabulary file in JSON."""
    raw = spark.read.option("multiLine", True).schema("vocabulary array<string>, special_tokens array<string>").json(path)
    special = F.array_contains(F.coalesce("special_tokens", F.array(*map(F.lit, SPECIALS))), F.col("token"))
    return raw.select("special_tokens", F.posexplode("vocabulary").alias("token_id", "token")).select("token_id", "token", special.alias("special"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All records of JSON lines; keys that a record lacks are null."""
    return spark.read.json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(phase, epoch, n, smiles) of numbered sample files."""
    file = F.col("_metadata.file_path")
    rows = spark.read.text(path).select(F.regexp_extract(file, r"phase(\d+)", 1).try_cast("int").alias("phase"), F.regexp_extract(file, r"ep(\d+)", 1).try_cast("int").alias("epoch"), F.regexp_extract("value", r"^(\d+): (.*)$", 1).try_cast("int").alias("n"), F.regexp_extract("value", r"^(\d+): (.*)$", 2).alias("smiles"))
    return rows.filter("n is not null")


def verified_files(files: DataFrame, sums: DataFrame) -> DataFrame:
    """Files (name, content) whose MD5 is the first word of their checksum line (name, line)."""
    wanted = sums.select("name", F.lower(F.split(F.trim("line"), r"\s+")[0]).alias("_md5"))
    return files.withColumn("_md5", F.md5(F.col("content").cast("binary"))).join(wanted, ["name", "_md5"], "left_semi").drop("_md5")


def paired_listing(names: DataFrame, suffix: str = ".md5", column: str = "name") -> DataFrame:
    """Names whose companion with the suffix is listed too; companions themselves are left out."""
    mates = names.filter(F.col(column).endswith(suffix)).select(F.expr(f"substr({column}, 1, length({column}) - {len(suffix)})").alias(column)).distinct()
    return names.filter(~F.col(column).endswith(suffix)).join(mates, column, "left_semi")
