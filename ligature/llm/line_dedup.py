"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only DataFrame functions. A line's text never travels with its hash: positions to drop come back to the
document, which is moved once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def fingerprint(key: Column) -> Column:
    """96 bits of two unrelated hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, DataFrame]:
    """All lines with a key of ``min_chars`` code points (doc_id, pos, h1, h2), and the hashes of those found in
    ``min_docs`` documents with the largest doc_id that holds each (h1, h2, n_docs, last_doc)."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    marked = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.cast("int").alias("pos"), F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))
    lines = docs.select("doc_id", F.inline(F.filter(marked, lambda x: x.isNotNull())))
    lines = materialise(lines, "lines")
    # one row for a document and hash, summed before the shuffle: rows of one document stand together
    once = lines.groupBy("doc_id", "h1", "h2").agg(F.lit(1).alias("one"))
    counts = once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return lines, materialise(counts.filter(F.col("n_docs") >= min_docs), "line-counts")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each document; ``kept`` is the text of its other lines.

    Rows that repeat a doc_id are one document, and have the same text; a row with a null doc_id keeps all lines.
    Null and empty texts are one empty line, which stays. Repeats within
    one document count as one document; in the document with the largest doc_id all of them stay. Further
    columns of ``docs`` are left out, so none can clash.
    """
    lines, hot = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    found = lines.join(hot.hint("merge"), ["h1", "h2"]).filter(F.col("doc_id") != F.col("last_doc"))
    places = materialise(found.groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "line-drops")
    split = docs.select("doc_id", lines_of(F.col("text")).alias("lines"))
    joined = split.join(places.hint("merge"), "doc_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    # array_except keeps a hash set, so this is linear in the lines; none of the places repeats
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.size("places") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"), kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(generate_series(1, len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (select key, max(doc_id) as last_doc from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, h.key is not null and k.doc_id <> h.last_doc as gone from keyed k left join hot h using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
