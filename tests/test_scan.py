"""Runs and positions in parts, against the plain windows and against Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ligature.operators import runs, scan, vocab
from ligature.operators.order import with_position

SCHEMA = "run_id long, step int, loss double, grad_norm double, phase string"


def steps(hot=900, rest=100, seed=0):
    """One run has most of the rows; flat stretches, NaN, infinity, nulls, gradients above 10."""
    rnd = random.Random(seed)
    sizes = [(7, hot), (None, 45), (1, 1), (3, 30), (9, rest - 76)]
    out = []
    for run, n in sizes:
        level = 5.0
        for k in range(n):
            level = level if 300 < k < 620 else level * rnd.choice([1, 0.99, 1.01])
            loss = rnd.choice([float("nan"), float("inf"), None]) if rnd.random() < 0.02 else 1e-9 if 700 < k < 720 else level
            out.append((run, 3 * k, loss, 20.0 if rnd.random() < 0.01 else 1.0 + rnd.random(), "p"))
    rnd.shuffle(out)
    return out


def text(df, *by):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*by, *[c for c in df.columns if c not in by]).collect())


@pytest.mark.parametrize("parts", [3, 16])
def test_hot_runs_in_segments(spark, parts):
    df = spark.createDataFrame(steps(), SCHEMA).repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for f in (lambda n: runs.stability(df, patience=30, warm=20, longest=n), lambda n: runs.best_so_far(df, "run_id", "step", "loss", longest=n)):
            assert text(f(10), "run_id", "step") == text(f(10**9), "run_id", "step")
        some = df.select(F.col("run_id").alias("seq_id"), "step", F.col("grad_norm").alias("value"), (F.col("grad_norm") / 3).alias("reward"))
        assert text(runs.gae(some, longest=10), "seq_id") == text(runs.gae(some, longest=10**9), "seq_id")
        cut = scan.segments(df, "run_id", ["step"], halo=19, least="loss")
        sizes = [r["count"] for r in cut.groupBy("run_id", "_seg").count().collect()]
        assert cut.filter("_own").count() == 1000 and max(sizes) < 3 * 1000 / parts + 21  # 90 % of the rows are one run's
        assert {r["run_id"]: r["n"] for r in cut.filter("_own").groupBy("run_id").agg(F.max("_n").alias("n")).collect()} == {7: 900, None: 45, 1: 1, 3: 30, 9: 24}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_halo_reaches_over_small_segments(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        rows = [(1, k, float(50 - k), 1.0, "p") for k in range(60)]
        cut = scan.segments(spark.createDataFrame(rows, SCHEMA), "run_id", ["step"], halo=19, least="loss").collect()
        own, seen = {}, {}
        for r in cut:
            if r["_n"]:
                (own if r["_own"] else seen).setdefault(r["_seg"], []).append(r["_n"])
        assert len(own) > 6  # segments shorter than the halo
        for seg, ns in own.items():
            assert sorted(seen.get(seg, [])) == list(range(max(1, min(ns) - 19), min(ns)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_steps_since_best_counts_from_the_first_of_equals(spark):
    losses = [3.0, 2.0, 2.0, float("nan"), 1.0, None, 1.0]
    df = spark.createDataFrame([(1, i, x, 1.0, "p") for i, x in enumerate(losses)], SCHEMA)
    for longest in (1, 100):
        assert [r["steps_since_best"] for r in runs.stability(df, longest=longest).orderBy("step").collect()] == [0, 0, 1, 2, 0, 1, 2]


@pytest.mark.parametrize("same", [None, "x"])
def test_positions_of_text(spark, same):
    rnd = random.Random(2)
    rows = [(same if rnd.random() < 0.9 else "".join(rnd.choice("abcé漢") for _ in range(3)), "k" + str(i).zfill(4)) for i in range(800)]
    rnd.shuffle(rows)
    out = with_position(spark.createDataFrame(rows, "a string, b string").repartition(4), ["a", "b"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["idx"])] == want and sorted(r["idx"] for r in out) == list(range(800))


def test_positions_of_numbers_that_are_mostly_null(spark):
    rows = [(None if i % 10 else i, i) for i in range(500)]
    out = with_position(spark.createDataFrame(rows, "a long, b long").repartition(4), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["idx"])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert with_position(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def test_a_long_vocabulary(spark):
    words = sorted({f"t{i * 7919 % 5000}" for i in range(5000)})
    out = vocab.number_tokens(spark.createDataFrame([(w,) for w in words], "token string").repartition(6)).orderBy("token_id").collect()
    assert [r["token_id"] for r in out] == list(range(len(words) + 5)) and [r["token"] for r in out[5:]] == words
    assert not math.isnan(out[0]["token_id"])
