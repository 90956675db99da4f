import hashlib
import math
import random

import numpy as np
import pytest

from ligature.llm import centroid_clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, seed=0, spread=0.2):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    return [(i, [float(np.float32(x + rnd.gauss(0, spread))) for x in rnd.choice(middles)], i % 3) for i in range(n)]


def brute(data, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    of = [sum(d for _, c, d in last if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, of[c], sum(of), sha[c]) for i, c, d in last), key=str)


def digest(spark, data, clash=False):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if clash:
        df = df.selectExpr("*", "1 as cluster", "2L as block", "3L as distance", "'v' as v")
    return sorted((tuple(r) for r in centroid_clusters.digest(df).collect()), key=str)


def odd():
    data = vectors(400)
    data += [data[0], data[0], (None, data[1][1], 1), (900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [float("nan")] * 64, 1), (904, [float("inf")] + [0.0] * 63, 1)]
    return data + [(905, [None] + [0.0] * 63, 1), (906, [0.5] * 64, None)] + [(2000 + i, [0.25] * 64, 0) for i in range(150)]


@pytest.mark.parametrize("clash", [False, True])
def test_clusters_by_brute_force(spark, clash):
    assert digest(spark, odd(), clash) == brute(odd())


def test_small_blocks_few_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "BLOCK", 16)
    monkeypatch.setattr(centroid_clusters, "BUCKET_BLOCKS", 1)
    grid = [(i, [float(i % 3), float(i // 3 % 3)] + [0.0] * 62, 0) for i in range(120)]  # many equal distances
    assert digest(spark, grid) == brute(grid)
    assert digest(spark, odd()) == brute(odd())
    assert digest(spark, grid[:7]) == brute(grid[:7])
    assert digest(spark, []) == []


def test_heaps_spare_scans(spark):
    data = vectors(1500, spread=0.05)
    rows, centroids, scans = centroid_clusters.cluster(spark.createDataFrame(data, SCHEMA))
    assert scans[0] == 1500 and scans[-1] < 1200 and rows.count() == 1500 and centroids.shape == (40, 64)


def test_bounds_never_spare_a_vector_that_moves():
    rnd = np.random.RandomState(5)
    data, centroids, drift = rnd.randint(-300, 300, (500, 64)), rnd.randint(-300, 300, (9, 64)), np.zeros(9)
    own, gap = centroid_clusters.scan(data, centroids)
    heaps = centroid_clusters.Heaps(9, [], [], [])
    for v in range(500):
        heaps.push(int(own[v]), float(gap[v]), v)
    spared = 0
    for turn in range(12):
        moved = centroids + rnd.randint(-12, 13, centroids.shape) // (turn + 1)
        drift, centroids = drift + centroid_clusters.shrinkage(centroids, moved), moved
        popped = [v for v, _ in heaps.expired(drift)]
        now, gap = centroid_clusters.scan(data, centroids)
        assert all(own[v] == now[v] for v in set(range(500)) - set(popped))
        spared += 500 - len(popped)
        for v in popped:
            heaps.push(int(now[v]), float(gap[v] + drift[now[v]]), v)
        own = now
    assert spared


def test_components_that_leave_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroid_clusters.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA))
