"""Raw documents to training tokens in five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Only the first reads
more than its docs: the labels that the classifier learns from.

Decisions come back by doc_id. Rows with a null doc_id therefore leave at the first stage; rows that repeat a doc_id
(with the same text) stay together up to the mix, which takes one of them. Null and empty texts are judged like others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm import bpe, exact_dedup, jaccard_join, mixing, quality_classifier
from ligature.llm.common import passing_tables, remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality_classifier.classify(docs, labels).filter("kept").select("doc_id")
    return docs.join(good.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    stay = exact_dedup.exact_groups(docs).filter("kept").select("doc_id")
    return docs.join(stay.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links the smallest doc_id stays."""
    stay = jaccard_join.near_duplicates(docs).filter("doc_id = class_id").select("doc_id")
    return docs.join(stay.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by the sources' targets, one row of each doc_id; a document that is taken twice is there twice."""
    _, pieces = mixing.mix_sources(docs, whole_documents=True, one_row=True)
    return docs.dropDuplicates(["doc_id"]).join(pieces.select("doc_id").hint("merge"), "doc_id").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, for each row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_by_source),
    ("byte_bpe", encode_tokens),
]

#: The classifier is learned and the mix is drawn, so SQL can't say the result; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            remove(spark, done)  # the next stage's docs are written, so nothing reads these any more
        docs, done = spark.read.parquet(path), path
    return docs.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
