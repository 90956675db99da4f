import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ligature.llm import common, exact_dedup, jaccard_join, line_dedup, suffix_dedup

from .fixtures import SCHEMA, WORD, docs, empty, rows


def got(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup_by_brute_force(spark, clash):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t, *_ in rows()}
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(low)
    for i, lines in split.items():
        for line in lines:
            if len(key(line)) >= 40:
                holds[key(line)].add(i)
    out = got(line_dedup.digest(docs(spark, clash=clash)))
    assert len(out) == len(split)
    dropped = 0
    for i, lines in split.items():
        stay = [line for line in lines if not (len(holds.get(key(line), ())) >= 5 and i != max(holds[key(line)]))]
        dropped += len(lines) - len(stay)
        assert (out[i]["n_lines"], out[i]["n_dropped"], out[i]["kept_sha256"]) == (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    assert dropped


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_with_and_without_collisions(spark, bits):
    by = defaultdict(list)
    for i, t, *_ in rows():
        by[t or ""].append(i)
    out = got(exact_dedup.exact_groups(docs(spark, clash=True), bits))
    for text, ids in by.items():
        for i in ids:
            assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert out[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chunks_are_cut_by_content():
    rnd = np.random.RandomState(1)
    body = rnd.randint(97, 123, 60000).astype(np.uint8)
    moved = np.concatenate([np.full(777, 65, np.uint8), body])
    ends, shifted = exact_dedup.cut_points(body), {e - 777 for e in exact_dedup.cut_points(moved)}
    assert ends[-1] == len(body) and len(shifted.intersection(ends)) > len(ends) - 4
    assert all(b - a <= exact_dedup.MAX for a, b in zip([0, *ends], ends))


def brute_links(data, threshold=0.8):
    sets = {}
    for i, t, *_ in data:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    links, up = Counter(), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in sets}


def test_jaccard_join_by_brute_force(spark):
    data = rows()
    chain = data[0][1] + " " + " ".join(f"w{k}" for k in range(200))
    words = chain.split()
    more = [(1000 + k, " ".join(words[k * 4 :]), "en", "s1", 0) for k in range(40)]  # neighbours are alike, ends aren't
    out = got(jaccard_join.near_duplicates(spark.createDataFrame(data + more, SCHEMA).repartition(3)))
    for i, (cls, n) in brute_links(data + more).items():
        assert (out[i]["class_id"], out[i]["n_links"]) == (cls, n)


def test_jaccard_join_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 4)
    base = [f"w{k}" for k in range(150)]
    data = [(k, " ".join(base[:k] + ["new"] + base[k:]), "en", "s", 0) for k in range(40)]
    out = got(jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)))
    for i, (cls, n) in brute_links(data).items():
        assert (out[i]["class_id"], out[i]["n_links"]) == (cls, n)


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join_of_clusters_with_near_and_far_texts(spark, monkeypatch, block):
    """Texts at all distances from the middle of their cluster: counted by classes, or met in blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", block)
    rnd = np.random.RandomState(2)
    data, n = [], 0
    for c in range(3):
        base = [f"c{c}w{k}" for k in range(160)]
        for edits in [0, 0, *range(1, 7)] * 5:
            words = list(base)
            for at in rnd.choice(160, edits, replace=False):
                words[at] = f"x{rnd.randint(30)}"
            data.append((n, " ".join(words[: 160 - rnd.randint(0, 2) * 25]), "en", "s", 0))
            n += 1
    out = got(jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)))
    want = brute_links(data)
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == want
    assert len({k for _, k in want.values()}) > 10


@pytest.mark.parametrize("threshold, bands", [(0.3, 160), (0.5, 80), (0.8, 32), (0.95, 16)])
def test_jaccard_join_at_other_thresholds(spark, threshold, bands):
    """The bands follow from the threshold, so lower ones lose no pairs either."""
    rnd = np.random.RandomState(4)
    assert jaccard_join.VALUES // jaccard_join.band_rows(threshold) == bands
    data = rows()
    for c in range(30):
        words = [f"c{c}w{k}" for k in range(80)]
        for edits in range(6):
            at = set(rnd.choice(80, edits * 2, replace=False).tolist())
            data.append((2000 + len(data), " ".join("x" if k in at else w for k, w in enumerate(words)), "en", "s", 0))
    out = got(jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), threshold))
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == brute_links(data, threshold)


def test_jaccard_join_refuses_a_threshold_it_cannot_serve(spark):
    with pytest.raises(ValueError):
        jaccard_join.near_duplicates(docs(spark), 0.01)


def test_jaccard_join_of_a_cluster_of_thousands(spark, monkeypatch):
    """Lightly edited copies of one text are counted by classes, without any pair of blocks; a few heavy ones meet them."""
    rnd = np.random.RandomState(4)
    base, data = [f"w{k}" for k in range(200)], []
    for i in range(2000):
        words = list(base)
        for at in rnd.choice(200, rnd.randint(0, 3) if i % 100 else 6, replace=False):
            words[at] = f"e{i}"
        data.append((i, " ".join(words), "en", "s", 0))
    copied = []
    meet = jaccard_join.together
    monkeypatch.setattr(jaccard_join, "together", lambda df, keys: meet(df, keys) if copied.append(df.count()) is None else None)
    out = got(jaccard_join.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t, *_ in data)]
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    holds = np.zeros((len(sets), len(number)), np.float32)
    for i, own in enumerate(sets):
        holds[i, [number[x] for x in own]] = 1
    common, size = holds @ holds.T, holds.sum(1)
    linked = common >= 0.8 * (size[:, None] + size - common) - 1e-6
    assert [out[i]["n_links"] for i in range(len(data))] == (linked.sum(1) - 1).tolist()
    loose = [i for i in range(len(data)) if linked[i].sum() == 1]
    first = min(set(range(len(data))) - set(loose))
    assert all(out[i]["class_id"] == (i if i in loose else first) for i in out)  # all others hang together here
    assert sum(copied) < 10 * len(data)


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard_join.least_matches()
    assert all(0 < least[n] < 0.8 * n for n in jaccard_join.STEPS)
    signs = np.zeros((2, 160), np.uint8)
    signs[1, ::5] = 1  # four of five values agree
    assert jaccard_join.survive(signs, np.array([0]), np.array([1]), least)[0]
    signs[1] = 1
    assert not jaccard_join.survive(signs, np.array([0]), np.array([1]), least)[0]


@pytest.mark.parametrize("shard_bytes", [1 << 18, 500])
def test_suffix_dedup_by_brute_force(spark, shard_bytes):
    texts = {i: (t or "").encode() for i, t, *_ in rows()}
    count = Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    out = got(suffix_dedup.remove_repeats(docs(spark, clash=True), shard_bytes=shard_bytes))
    assert len(out) == len(texts)
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        assert (out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], bytes(out[i]["kept"])) == (len(b), int(gone.sum()), spans, kept)


def brute_repeats(texts):
    count = Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 18, 2000])
def test_suffix_dedup_of_one_hot_line(spark, shard_bytes):
    """A line of 190 bytes in many texts repeats only with what stands around it; periods repeat within a text."""
    rnd = np.random.RandomState(5)
    word = lambda n: "".join(chr(97 + c) for c in rnd.randint(0, 26, n))
    line, ends = word(190), [word(12) for _ in range(5)]
    texts = {i: (word(150) + ends[i % 5][: i % 13] + line + ends[(i // 3) % 5] + word(150)).encode() for i in range(160)}
    texts |= {500: ("ab" * 400).encode(), 501: ("x" + "-" * 900 + word(300)).encode(), 502: ("-" * 260 + word(300)).encode(), 503: (word(210) + "q").encode()}
    df = spark.createDataFrame([(i, b.decode(), "en", "s", 0) for i, b in texts.items()], SCHEMA).repartition(4)
    out = got(suffix_dedup.remove_repeats(df, shard_bytes=shard_bytes))
    want = brute_repeats(texts)
    assert {i: bytes(r["kept"]) for i, r in out.items()} == want and any(len(want[i]) < len(texts[i]) for i in range(160)) and want[503] == texts[503]


def test_suffix_dedup_cuts_long_texts_into_segments(spark, monkeypatch):
    rnd = np.random.RandomState(6)
    shared = "".join(chr(97 + c) for c in rnd.randint(0, 26, 900))
    long = "".join(chr(97 + c) for c in rnd.randint(0, 26, 9000))
    texts = {1: (long[:3000] + shared + long[3000:]).encode(), 2: (shared + long[:700]).encode(), 3: ("漢字" * 1500 + shared[100:]).encode()}
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1024)
    pieces = []
    for b in texts.values():
        for a, b2, start, end in suffix_dedup.segments(np.array([0, len(b)]), 200):
            raw = np.frombuffer(b, np.uint8)[start:end]
            *_, lo, n, _ = suffix_dedup.contexts(raw, np.array([0, len(raw)]), 200, 73)
            pieces.append((lo + start, n))
        assert sum(int(n.sum()) for _, n in pieces) == len(b) - 199
        pieces.clear()
    df = spark.createDataFrame([(i, b.decode(), "en", "s", 0) for i, b in texts.items()], SCHEMA)
    assert {i: bytes(r["kept"]) for i, r in got(suffix_dedup.remove_repeats(df)).items()} == brute_repeats(texts)


def test_spans_of_words_that_defeat_polynomials_differ():
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 for every odd base."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(word.encode(), np.uint8)
    for size in (1024, 2048):
        a, b = common.span_hashes(data, np.array([0, size]), np.array([size, 2 * size]))
        assert a != b
    sizes = np.array([0, 1, 7, 8, 9, 255, 256, 257, 300])
    assert len(set(common.span_hashes(data, np.zeros(9, np.int64), sizes).tolist())) == 9
    one, two = jaccard_join.shingle_sets(data[:2048], np.array([0, 1024, 2048]))
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_suffix_order_and_common_prefixes():
    rnd = np.random.RandomState(3)
    text = np.concatenate([rnd.randint(97, 99, 900), np.tile(rnd.randint(97, 100, 7), 90), rnd.randint(97, 99, 900)]).astype(np.uint8)
    starts = np.arange(len(text) - 200)
    raw = text.tobytes()
    ordered = suffix_dedup.sorted_starts(text, starts, 200)
    keys = [raw[s : s + 200] for s in ordered]
    assert keys == sorted(keys) and len(set(ordered.tolist())) == len(starts)
    common = suffix_dedup.kasai(text, starts, ordered, starts // 64, 200)
    before = dict(zip(ordered[1:].tolist(), ordered[:-1].tolist()))
    for s in starts.tolist():
        want = 0
        if s in before:
            while want < 200 and raw[s + want] == raw[before[s] + want]:
                want += 1
        assert common[s] == want


def test_suffix_dedup_of_partners_without_an_id(spark):
    rnd = np.random.RandomState(8)
    shared = bytes(rnd.randint(97, 123, 260).astype(np.uint8)).decode()
    data = [(None, f"start {shared} end", None, None, 0), (1, f"other {shared} tail", None, None, 0), (None, f"third {shared}", None, None, 0), (None, None, None, None, 0), (2, "alone " * 3, None, None, 0)]
    texts = {k: (r[1] or "").encode() for k, r in enumerate(data)}
    want = sorted((str(data[k][0]), left) for k, left in brute_repeats(texts).items())
    out = suffix_dedup.remove_repeats(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in out) == want
    assert sum(r["n_removed"] for r in out) >= 3 * 260


def test_spans_are_numbered_by_their_bytes():
    words = [b"flmijlfpaqbmhngz", b"imshxixoBJXq3JdZ", b"", b"a", b"flmijlfpaqbmhngz", b"", b"ab", b"imshxixoBJXq3JdZ", b"b" * 700, b"b" * 700, b"b" * 699 + b"c"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = np.append(0, ends[:-1])
    for hashes in (None, np.zeros(len(words), np.uint64), np.array([len(w) for w in words], np.uint64)):
        numbers = common.span_numbers(data, starts, ends, hashes).tolist()
        assert all((numbers[i] == numbers[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    h = common.span_hashes(data, starts, ends)
    assert h[0] == h[1]  # the two that the hash alone takes for one


def test_empty_tables(spark):
    for run in (line_dedup.digest, exact_dedup.exact_groups, jaccard_join.near_duplicates, suffix_dedup.digest):
        assert run(empty(spark)).count() == 0
