import hashlib
import random
import zlib

import numpy as np
import pytest

from ligature.llm import periodic_runs

from .fixtures import SCHEMA, WORD, docs, empty, rows


def brute_runs(w):
    """Each period by itself: maximal stretches of words that equal the word a period later, the smallest period of each."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        a = (h // 10) % len(w)
        p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs),
        *(top or (None, None, None)),
        top and 1000 * top[1] // top[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def words(seed):
    """Few different words, runs of every length of period, also one in another and ones that touch."""
    rnd, out = random.Random(seed), []
    while len(out) < 600:
        base = [rnd.choice("abcde") for _ in range(rnd.choice([1, 1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 33, 50]))]
        if rnd.random() < 0.3:
            base = base * rnd.randint(2, 5) + [rnd.choice("abcde")]
        out += base * rnd.randint(1, 6) + base[: rnd.randint(0, len(base))]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_by_brute_force(seed):
    w = words(seed)
    found = periodic_runs.find_runs(np.array([ord(x) for x in w], np.int64))
    assert [tuple(r) for r in found.tolist()] == brute_runs(w)


def test_runs_of_plain_and_of_one_word():
    rnd = random.Random(3)
    plain = [rnd.randint(0, 30) for _ in range(3000)]
    for w in ([], [1], [1] * 5, [1] * 6, [1] * 5000, plain, plain[:700] * 4, plain[:700] * 3 + plain[:699]):
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int64)).tolist()] == brute_runs(w)


def odd_rows():
    data = rows(n=150)
    data += [(1000 + k, " ".join(words(k)), "en", "s", 1) for k in range(6)]
    return data + [data[3], data[3], (None, data[4][1], "en", "s", 1), (-7, None, None, None, None), (5000, "la " * 4000, "en", "s", 1)]


@pytest.mark.parametrize("clash", [False, True])
def test_digest_by_brute_force(spark, clash):
    data = odd_rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    if clash:
        df = df.selectExpr("*", "1L as n_runs", "'x' as runs", "2L as start", "'k' as kept")
    out = sorted((tuple(r) for r in periodic_runs.digest(df).collect()), key=str)
    assert out == sorted(((r[0], *brute(r[0], r[1])) for r in data), key=str)
    assert sum(r[1] > 0 for r in out) > 12


def test_small_blocks_and_empty_tables(spark, monkeypatch):
    assert periodic_runs.digest(empty(spark)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in periodic_runs.collapse(docs(spark)).collect()}
    assert kept[len(rows()) - 3] == " ".join("a b".split()) and kept[len(rows()) - 5] == "9 9 9"
    with pytest.raises(ValueError):
        periodic_runs.collapse(docs(spark), times=2)
