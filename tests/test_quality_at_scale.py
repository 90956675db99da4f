"""Measures over all rows: against all pairs, sorted lists, and counted attempts."""

import math
import random
from itertools import combinations
from statistics import mean, quantiles, stdev

import pytest
from pyspark.sql import functions as F

from ligature.operators import plugs, quality


def sets(n, seed=0):
    rnd = random.Random(seed)
    kinds = [[f"g{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 12))] for _ in range(90)]
    return [rnd.choice(kinds) for _ in range(n)] + [[], None, ["alone"], ["a", "a", "b"]]


def brute(data):
    known = [set(x) for x in data if x]
    return len(known) * (len(known) - 1) // 2, 1 - mean(len(a & b) / len(a | b) for a, b in combinations(known, 2))


def frame(spark, data):
    return spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, f array<string>").repartition(4)


def test_diversity_of_2000_rows(spark):
    data = sets(2000)
    pairs, want = brute(data)
    got = quality.diversity_all(frame(spark, data), "f").first()
    assert got["pairs"] == pairs and math.isclose(got["diversity"], want, rel_tol=1e-9)
    guess = quality.diversity_estimate(frame(spark, data), "f", 256).first()
    assert guess["pairs"] == pairs and abs(guess["diversity"] - want) < 5 * guess["error"] and guess["error"] < 0.02
    with pytest.raises(ValueError, match="diversity_estimate"):
        quality.diversity_all(frame(spark, data), "f", most_pairs=10)


def test_diversity_is_unbiased(spark):
    data = sets(60, 1)
    _, want = brute(data)
    runs = [quality.diversity_estimate(frame(spark, data), "f", 64, lambda k, g, s=s: F.xxhash64(k, g, F.lit(s))).first() for s in range(8)]
    assert abs(mean(r["diversity"] for r in runs) - want) < 4 * mean(r["error"] for r in runs) / math.sqrt(8)


def test_diversity_of_few_rows(spark):
    for data in ([], [["a"]], [["a"], ["a"]], [["a"], ["b"]]):
        want = {0: None, 1: None}.get(len(data), 0.0 if data and data[0] == data[-1] else 1.0)
        assert quality.diversity_all(frame(spark, data), "f").first()["diversity"] == want
        assert quality.diversity_estimate(frame(spark, data), "f").first()["diversity"] == want


def test_cosines_from_the_gram_matrix(spark):
    rnd = random.Random(3)
    data = [[rnd.gauss(0.3, 1) for _ in range(8)] for _ in range(120)] + [[0.0] * 8]
    cos = [sum(x * y for x, y in zip(a, b)) / (max(math.dist(a, [0] * 8), 1e-12) * max(math.dist(b, [0] * 8), 1e-12)) for i, a in enumerate(data) for j, b in enumerate(data) if i != j]
    rows = [(v,) for v in data] + [(None,), ([1.0],), ([None] * 8,)]
    got = quality.cosine_moments(spark.createDataFrame(rows, "v array<double>").repartition(5), "v", 8).first()
    assert got["pairs"] == len(cos) and math.isclose(got["mean"], mean(cos), rel_tol=1e-9) and math.isclose(got["std"], stdev(cos), rel_tol=1e-9)
    assert quality.cosine_moments(spark.createDataFrame([], "v array<double>"), "v", 8).first()["pairs"] == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_exact_quantiles(spark, n):
    rnd = random.Random(n)
    data = [float(rnd.choice([rnd.randint(0, 9), rnd.gauss(0, 100), 4.0])) for _ in range(n)]
    df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x double").repartition(7)
    got = quality.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    want = [min(data), *(quantiles(data, n=4, method="inclusive") if n > 1 else data * 3), max(data)]
    assert got["n"] == n and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got["values"], want))


def test_no_values_have_no_quantiles(spark):
    got = quality.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).first()
    assert got["n"] == 0 and got["values"] == [None]


def test_variants_by_counted_attempts(spark):
    calls = spark.sparkContext.accumulator(0)

    def make(text, attempt):
        calls.add(1)
        if text == "bad":
            raise ValueError(text)
        return None if attempt == 0 else text[::-1] if text == "few" else f"{text}{attempt // 2}"

    rows = [("CC",), ("CC",), ("few",), ("bad",), ("  ",), (None,), ("CO",)]
    df = spark.createDataFrame(rows, "smiles string").repartition(3)
    out = sorted(map(tuple, plugs.variants_table(df, make, 3).collect()))
    assert out == [(t, k, f"{t}{k}") for t in ("CC", "CO") for k in range(3)] + [("few", 0, "wef")]
    # 5 attempts for three variants, 9 where they run out, 1 for the invalid one; repeated strings once
    assert calls.value == 5 + 5 + 9 + 1
    first = plugs.variants_table(df.filter("smiles = 'CO'"), make, 2, first=lambda t: "canonical").collect()
    assert [r["variant"] for r in first] == ["canonical", "CO0"]
