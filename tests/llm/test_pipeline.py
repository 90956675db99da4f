import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from ligature.llm import bpe, common

from .fixtures import SCHEMA, docs, empty, labels, rows
from .test_dedup import brute_links
from .test_text import learnable


def test_pipeline_by_stages(spark, tmp_path):
    data = [(10_000 + r[0], *r[1:]) for r in rows()] + learnable(120)
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in learnable(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, text = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[1] for r in data}
    kept = [data]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append([tuple(r) for r in frame.collect()])
        assert {r[0] for r in kept[-1]} <= {r[0] for r in kept[-2]} and all(text[r[0]] == r[1] for r in kept[-1])
    assert not {r[0] for r in kept[1] if r[0] < 10_000 and r[0] % 5 == 0}
    last = {}
    for r in kept[1]:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", -1))
    assert {r[0] for r in kept[2]} == set(last.values())
    assert {r[0] for r in kept[3]} == {i for i, (cls, _) in brute_links(kept[2]).items() if i == cls}
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert len(out) == len(kept[4])
    for r in out:
        ids = lib.encode_ordinary(text[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
        assert stage(spark, docs(spark, clash=True), str(tmp_path)).count() >= 0


def test_stages_decide_by_doc_id(spark, tmp_path):
    good = learnable(60)
    data = good + [good[1], (None, good[2][1], "en", "s0", 0)]
    spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in good], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:3]:
        ids = [r["doc_id"] for r in stage(spark, frame, str(tmp_path)).collect()]
        assert None not in ids and ids.count(1) == 2


def test_mix_takes_repeated_rows_once(spark, tmp_path):
    good = learnable(40)
    plain = spark.createDataFrame(good, SCHEMA).repartition(3)
    often = spark.createDataFrame(good + [good[1]] * 30 + [good[2]], SCHEMA).repartition(5)
    want, got = ([r["doc_id"] for r in corpus_pipeline.mix_by_source(spark, frame, str(tmp_path)).collect()] for frame in (plain, often))
    assert sorted(got) == sorted(want) and max(map(got.count, got)) <= 2


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(out[k] == 0 for k in range(41)) and all(out[k] == 100 for k in range(100, 160)) and out[300] == out[200] == 200
    assert common.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    for n, m in ((30, 20), (60, 70), (200, 190)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n + k, n + 1 + k) for k in range(0, 18, 2)] + [(n + 40, n + 30 + k) for k in range(20)]
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        while any(least[a] != least[b] for a, b in edges if a != b):
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        out = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "brute").collect()
        assert len(out) == len(least) and {r["node"]: r["component"] for r in out} == least


def test_components_of_stars_take_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "materialise", lambda df, label: made.append(label) or df)
    out = common.components(spark.createDataFrame([(5, 1), (1, 6), (7, 2), (5, 1)], "a long, b long"), "plain").collect()
    assert {r["node"]: r["component"] for r in out} == {1: 1, 5: 1, 6: 1, 2: 2, 7: 2} and made == ["plain-edges"]


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    good = learnable(60)
    spark.createDataFrame(good, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in good], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = tmp_path / "shared"
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda session: str(shared))
    kept = common.materialise(spark.range(5), "another")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() and kept.count() == 5
    assert {p.parent.name for p in shared.glob("pipeline-*/*/*.parquet")} == {"byte_bpe"}
    assert {p.parent.name.split("-")[0] for p in shared.glob("tables/**/*.parquet")} == {"another"}


def test_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda session: str(tmp_path / "shared"))
    made = common.materialise(spark.range(5), "five")
    assert made.count() == 5 and list((tmp_path / "shared").rglob("*.parquet"))
    common.clear_tables(spark)
    assert not list((tmp_path / "shared").rglob("*.parquet"))
    common.clear_tables(spark)
