"""Repeated rows, null and negative ids: no operator fails, and each gives what its docstring says."""

import public_tokenizers

from ligature.llm import bpe, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, suffix_dedup

from .fixtures import SCHEMA, labels, rows


def odd(spark):
    data = rows(n=30)
    more = [data[0], data[0], (-5, data[1][1], "en", "s1", 0), (None, data[2][1], "de", None, 0), (None, "alone in the world with a null id", None, None, 0)]
    return spark.createDataFrame(data + more, SCHEMA).repartition(3), data + more


def test_no_operator_fails(spark):
    df, data = odd(spark)
    path, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    marks = labels(spark, data)
    for out in (
        jaccard_join.near_duplicates(df),
        language_id.held_out(df, pieces),
        bpe.round_trip(df, path, public_tokenizers.PATTERN),
        line_dedup.digest(df),
        exact_dedup.exact_groups(df),
        quality_rules.apply_rules(df, marks),
        quality_classifier.classify(df, marks),
        suffix_dedup.digest(df),
        mixing.taken(df),
    ):
        assert out.count() == len(data)


def test_repeated_rows(spark):
    df, data = odd(spark)
    lines = [r for r in line_dedup.digest(df).collect() if r["doc_id"] == 0]
    assert len(lines) == 3 and len({r["n_dropped"] for r in lines}) == 1 and lines[0]["n_dropped"] <= lines[0]["n_lines"]
    same = [r for r in exact_dedup.exact_groups(df).collect() if r["doc_id"] == 0]
    assert all(r["group_size"] == 3 and r["kept"] for r in same)
    near = [r for r in jaccard_join.near_duplicates(df).collect() if r["doc_id"] == 0]
    assert all(r["n_links"] == 2 and r["class_id"] == 0 for r in near)
    assert {r["class_id"] for r in jaccard_join.near_duplicates(df).collect() if r["doc_id"] in (1, -5)} == {-5}
