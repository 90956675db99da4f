import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ligature.llm import bpe, html_extract, language_id, mixing, quality_classifier, quality_rules

from .fixtures import SCHEMA, WORD, docs, empty, labels, rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CODEC = bpe.codec(PATH, PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeingthox =-!é漢😀\n1'"), max_size=300))
def test_bpe_agrees_with_the_library(text):
    assert CODEC.encode(text) == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_bpe_joins_long_pieces_exactly():
    rnd = random.Random(2)
    for size in (30, 400, 9000):
        text = "".join(rnd.choice("abcdefghijklmnop") for _ in range(size))
        assert CODEC.encode(text) == TIKTOKEN.encode_ordinary(text)
    assert CODEC.encode("-" * 70000) == TIKTOKEN.encode_ordinary("-" * 70000)


def test_bpe_round_trip_of_a_table(spark):
    df = docs(spark, clash=True)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df, PATH, PATTERN).collect()}
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    marks = {r["doc_id"]: r for r in bpe.round_trip(df, PATH, PATTERN).collect()}
    for i, text, *_ in rows():
        want = TIKTOKEN.encode_ordinary(text or "")
        assert ids[i] == want and back[i] == (text or "").encode() and marks[i]["n_tokens"] == len(want)
        assert marks[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert marks[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


ARTICLE = "<h1>Title &amp; more</h1><p>A first   paragraph&nbsp;of <i>some</i> length, with words enough to be dense.</p><p>Short.<p>Another one &#x41;&lt; that goes on and on for a while so that it counts.<ul><li>item one<li>item two</ul>"
WANT = "Title & more\nA first paragraph of some length, with words enough to be dense.\nShort.\nAnother one A< that goes on and on for a while so that it counts.\nitem one\nitem two"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>Menu</a></nav><article>{ARTICLE}</article><footer>F</footer></body></html>",
        f"<body><header><a>Home</a></header><div class='ad'>Buy</div><main>{ARTICLE}<form><p>Mail</p></form></main><aside>Side</aside>",
        f"<body><div id=menu><ul><li><a>One</a></ul></div><div class=wrap><div class='post-content'>{ARTICLE}<script>if(a<b){{}}</script></div><div class=sidebar>{ARTICLE}</div></div><div class='comments'>{ARTICLE}</div><div class='cookie-notice'>We use cookies</div>",
        f"<nav><ul><li>never closed<article>{ARTICLE}",
        f"<article>{ARTICLE}</article><section class=comments><article>{ARTICLE}</article></section>",
        f"<article>{ARTICLE}<!-- note --><noscript>no</noscript></article><a hre",
    ],
)
def test_html_main_text(page):
    assert html_extract.main_text(page) == WANT


STORY = "".join(f"<p>Paragraph {k} of the story goes on for a good while, so that its line is a dense one.</p>" for k in range(8))
TOLD = "\n".join(f"Paragraph {k} of the story goes on for a good while, so that its line is a dense one." for k in range(8))
CARDS = "".join(f"<article class=card><h3><a href=/{k}>Teaser {k}</a></h3><p>Read on.</p></article>" for k in range(4))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav>Menu</nav><main><div>{STORY}</div><section class=more>{CARDS}</section></main>",
        f"<body><div>{STORY}</div><section class=more>{CARDS}</section>",
        f"<article>{STORY}<article class=comment><p>A reply that has some length, too, but not as much.</p></article></article>",
        f"<article>{STORY}</article><article class=comment><p>A reply that has some length, too, but not as much.</p></article>",
        f"<article>{STORY}</article><section class=comments>{''.join(f'<article>{STORY}</article>' for _ in range(5))}</section>",
    ],
)
def test_html_dense_text_chooses_the_region(page):
    assert html_extract.main_text(page) == TOLD


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='content with-sidebar'", "div class='post comments-open'", "form action=/", "div class=header"])
def test_html_names_of_wrappers_are_evidence_only(wrapper):
    tag, side = wrapper.split()[0], f"<div class=sidebar><p>{WANT}</p></div><div class=comments>{STORY}</div>"
    assert html_extract.main_text(f"<body><{wrapper}><article>{STORY}</article>{side}</{tag}>") == TOLD
    if wrapper != "div class=header":
        assert html_extract.main_text(f"<body><{wrapper}><div>{STORY}</div><div class=sidebar><p>Side</p></div></{tag}>") == TOLD


def brute_dense(lines):
    """Ratio, Gaussian and two means, number by number."""
    import math

    ratio = [0.0 if x.aside else (len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    weight = {d: math.exp(-0.5 * (d / html_extract.SIGMA) ** 2) for d in range(-html_extract.RADIUS, html_extract.RADIUS + 1)}
    smooth = [sum(w * ratio[i + d] for d, w in weight.items() if 0 <= i + d < len(ratio)) / sum(weight.values()) for i in range(len(ratio))]
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        near = [x for x in smooth if x < (low + high) / 2]
        far = [x for x in smooth if x >= (low + high) / 2]
        low, high = (sum(near) / len(near) if near else low), sum(far) / len(far)
    mean = sum(smooth) / len(smooth)
    edge = min((low + high) / 2, (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5)
    return [x > 0 and x >= edge - 1e-9 and not line.aside for x, line in zip(smooth, lines)]


def brute_text(html):
    """The article of a page without doubted names: of all elements, the innermost article or main that holds 0.6 of the
    dense text; without one the last element on the way down that does."""
    page = html_extract.parse(html or "")
    if not page.lines:
        return ""
    flags = brute_dense(page.lines)
    total = sum(len(x.text) for x, f in zip(page.lines, flags) if f)
    if not total:
        return ""
    held = {n: sum(len(x.text) for x, f in zip(page.lines, flags) if f and n in x.path) for n in page.kinds}
    enough = [n for n in page.kinds if held[n] >= 0.6 * total]
    marked = [n for n in enough if page.kinds[n] in ("article", "main")]
    region = max(marked) if marked else None
    path = sorted(enough)  # elements are numbered as they open, so these, each in the one before, are the way down
    for n in path if region is None else []:
        if page.kinds[n] in ("tr", "td", "li"):
            break
        region = n
    kept = [x for x in page.lines if not x.aside and (region is None or region in x.path)]
    return "\n".join(x.text for x in kept if marked or x.linked < 0.8 * len(x.text))


def test_html_agrees_with_brute_force_on_real_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    plain = [re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", h) for h in pages]
    bare = [re.sub(r"<(/?)(article|main|nav|footer)\b[^>]*>", r"<\1div>", h) for h in plain]
    for html in plain + bare:
        page = html_extract.parse(html)
        assert not page.doubted and html_extract.dense(page.lines).tolist() == brute_dense(page.lines)
        assert html_extract.main_text(html) == brute_text(html)


def test_html_density_decides_without_names(monkeypatch):
    """No article, no main, no class: links and short lines are half of the page."""
    rnd = random.Random(9)
    word = lambda n: " ".join("".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    pages, want = [], []
    for k in range(40):
        story = [word(rnd.randint(25, 60)) for _ in range(rnd.randint(4, 9))]
        story.insert(2, word(3))  # a short paragraph within the story stays
        links = "".join(f"<li><a href=/{j}>{word(5)}</a></li>" for j in range(40))
        bits = "".join(f"<div><b>{word(1)}</b><i>{word(1)}</i></div>" for _ in range(60))
        pages.append(f"<body><div><ul>{links}</ul></div><div>{bits}</div><div>{''.join(f'<p>{p}</p>' for p in story)}</div><div>{bits}</div><div><ul>{links}</ul></div>")
        want.append("\n".join(story))
    assert [html_extract.main_text(p) for p in pages] == want
    monkeypatch.setattr(html_extract, "dense", lambda lines: np.array([not x.aside for x in lines]))
    assert sum(html_extract.main_text(p) == w for p, w in zip(pages, want)) <= 4
    monkeypatch.setattr(html_extract, "dense", lambda lines: np.zeros(len(lines), bool))
    assert not any(html_extract.main_text(p) for p in pages)


def test_html_odd_pages(spark):
    pages = [(0, "u", None), (1, None, ""), (2, "u", "<p"), (3, "u", "plain"), (4, "u", "<nav>only</nav>"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<article><p>" + "long " * 50000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert [out[i]["text"] for i in range(6)] == ["", "", "", "plain", "", "deep"]
    assert out[6]["n_chars"] == 250000 - 1 and out[1]["url"] is None
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_counts(text):
    words = WORD.findall(text)
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i, t in enumerate(zip(words, words[1:], words[2:])) if threes[t] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_and_judge(spark):
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(spark, clash=True), labels(spark)).collect()}
    assert len(out) == len(rows())
    for i, text, *_ in rows():
        r, want = out[i], brute_counts(text or "")
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["p_quality"] >= 0.5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.apply_rules(docs(spark), none).collect())
    assert quality_rules.apply_rules(empty(spark), none).count() == 0


def test_quality_rules_tell_lines_that_defeat_polynomials_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word}\n{other}\n{word}"
    data = [(1, f"{word}\n{other}", "en", "s", 0), (2, text, "en", "s", 0)]
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(data, SCHEMA), labels(spark)).collect()}
    assert out[1]["n_dup_lines"] == 0 and out[2]["n_dup_lines"] == brute_counts(text)[3] == 1


def test_quality_rules_bound_what_the_driver_holds(spark):
    data = learnable(200) + [(900 + k, " ".join(f"w{k}x{j}" for j in range(20_000)), "en", "s", 0) for k in range(3)]
    df = spark.createDataFrame(data, SCHEMA)
    marks = spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in data], "doc_id long, quality int, toxic int")
    rows = quality_rules.evidence(quality_rules.labelled(df, marks, 4000)).persist()
    for most in (1 << 23, 100_000, 2000):
        n = [r["n"] for r in quality_rules.bounded(rows, most).select("n").collect()]
        assert sum(n) <= most and n and (len(n) == len(data)) == (most == 1 << 23)
    rows.unpersist()
    out = quality_rules.score(df, quality_rules.fit(df, marks, most_entries=20_000)).collect()
    assert sum(r["p_quality"] >= 0.5 for r in out if r["doc_id"] % 5) >= 150


def learnable(n=400):
    rnd = random.Random(4)
    good = "the of and to in is it that was for on are as with they be at one have this".split()
    out = []
    for i in range(n):
        bad = i % 5 == 0
        words = [rnd.choice(good) for _ in range(rnd.randint(60, 120))]
        out.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "en", f"s{i % 3}", 0))
    return out


def test_quality_models_learn(spark):
    data = learnable()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    marks = spark.createDataFrame([(r[0], int(r[0] % 5 != 0), 0) for r in data if r[0] % 2], "doc_id long, quality int, toxic int")
    for out in (quality_rules.apply_rules(df, marks), quality_classifier.classify(df, marks)):
        rest = [r for r in out.collect() if r["doc_id"] % 2 == 0]
        assert sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in rest) >= 0.95 * len(rest)


def test_quality_classifier_shrinks_sparse_sites(spark):
    out = {r["doc_id"]: r for r in quality_classifier.classify(docs(spark, clash=True), labels(spark)).collect()}
    assert len(out) == len(rows())
    assert all(0 <= r[c] <= 1 for r in out.values() for c in ("p_document", "p_host", "p_path", "posterior"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_classifier.classify(docs(spark), none).collect())
    assert quality_classifier.classify(empty(spark), none).count() == 0


def brute_sites(rows):
    """p_host, p_path and posterior of each row from its p_document, by the formulas, one row after the other."""
    from math import exp, log

    def strength(groups):  # (n, total, prior)
        e = sum((t - n * m) ** 2 - n * m * (1 - m) for n, t, m in groups)
        p = sum(n * (n - 1) * m * (1 - m) for n, t, m in groups)
        rho = e / p if p else 0.0
        return min(1e4, max(1.0, 1 / rho - 1)) if rho > 0 else 1e4

    logit = lambda p: log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts, paths = {}, {}
    for r in rows:
        for d, key in ((hosts, r["host"]), (paths, (r["host"], r["path"]))):
            n, t = d.get(key, (0, 0.0))
            d[key] = (n + 1, t + r["p_document"])
    overall = sum(t for _, t in hosts.values()) / len(rows)
    k_host = strength([(n, t, overall) for n, t in hosts.values()])
    prior = {h: (t + k_host * overall) / (n + k_host) for h, (n, t) in hosts.items()}
    k_path = strength([(n, t, prior[h]) for (h, _), (n, t) in paths.items()])
    out = {}
    for r in rows:
        p, (hn, ht), (n, t) = r["p_document"], hosts[r["host"]], paths[r["host"], r["path"]]
        p_host = (ht - p + k_host * overall) / (hn - 1 + k_host)
        p_path = (t - p + k_path * p_host) / (n - 1 + k_path)
        z = log(p) - log(1 - p) + logit(p_path) - logit(overall)
        out[r["doc_id"]] = (p_host, p_path, 1 / (1 + exp(-z)))
    return out, overall


def test_quality_classifier_by_brute_force(spark):
    """Moments, shrinkage and leaving one out; hosts that differ, some with one document, and null ones."""
    rnd = random.Random(8)
    data = []
    for i, text, lang, _, n in learnable(600):
        host = ["bad", "good", "good", "mixed", None][rnd.randrange(5)] if i % 40 else f"lone{i}"
        if host == "bad" and i % 3 or host == "good" and i % 5 == 0 and i % 2:
            text = text.upper().replace(" ", "!! ")
        data.append((i, text, rnd.choice(["en", "de", None]), host, n))
    marks = spark.createDataFrame([(r[0], int("!!" not in r[1]), 0) for r in data if r[0] % 2], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(spark.createDataFrame(data, SCHEMA).repartition(3), marks).collect()
    want, overall = brute_sites(out)
    for r in out:
        assert all(abs(r[c] - w) < 1e-6 for c, w in zip(("p_host", "p_path", "posterior"), want[r["doc_id"]]))
        assert r["kept"] == (r["posterior"] >= 0.5)
    rate = {h: [r["p_path"] for r in out if r["host"] == h] for h in ("bad", "good")}
    assert max(rate["bad"]) < overall < min(rate["good"])
    # a site without others of its own has the corpus's rate, whatever its one document is like
    lone = [r for r in out if (r["host"] or "").startswith("lone")]
    assert {"!!" in data[r["doc_id"]][1] for r in lone} == {True, False} or len(lone) > 5
    assert all(abs(r["p_host"] - overall) < 1e-9 and abs(r["p_path"] - overall) < 1e-9 for r in lone)


def test_language_forward_sums_all_segmentations():
    import numpy as np

    names = sorted(["▁a", "▁ab", "a", "b", "ab", "▁", "bb"])
    probs = np.random.RandomState(0).dirichlet(np.ones(len(names)), 2).T
    full = language_id.table_of(probs)

    def brute(text, lang):
        if not text:
            return 1.0
        return sum(probs[names.index(text[:n]), lang] * brute(text[n:], lang) for n in range(1, len(text) + 1) if text[:n] in names)

    words = ["a", "ab", "abb", "bab", "aabbab"]
    got = language_id.word_scores(words, language_id.Pieces(names), full)
    for w, row in zip(words, got):
        for lang in range(2):
            assert abs(row[lang] - np.log(brute("▁" + w, lang))) < 1e-6
    counts = language_id.expected(["abb"], np.array([2.0]), np.array([1]), language_id.Pieces(names), full)
    assert abs((counts[: len(names), 1] * [len(x) for x in names]).sum() - 2 * 4) < 1e-6


def test_language_sums_cut_neither_words_nor_pieces(monkeypatch):
    """Words of 60 and 3,000 letters, pieces of 15, in blocks smaller than the pieces, against plain recursions."""
    from functools import cache

    long = "abbabaabbaababb"
    names = sorted(["▁a", "a", "b", "ab", "▁", "bba", long, "▁" + long, long[::-1]])
    probs = np.random.RandomState(1).dirichlet(np.ones(len(names)), 2).T
    full, finder = language_id.table_of(probs), language_id.Pieces(names)
    rnd = random.Random(3)
    words = [long * 4, "".join(rnd.choice("ab") for _ in range(60)), "ab" + long + "c" + long[::-1], "a", long]

    def brute(word, lang):
        text = "▁" + word

        @cache
        def tail(at):
            if at == len(text):
                return 1.0
            known = sum(probs[names.index(text[at : at + n]), lang] * tail(at + n) for n in range(1, 17) if text[at : at + n] in names and at + n <= len(text))
            return known + (language_id.FLOOR * tail(at + 1) if text[at] not in names else 0.0)

        return np.log(tail(0))

    for block in (256, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got = language_id.word_scores(words, finder, full)
        assert all(abs(got[i, lang] - brute(w, lang)) < 1e-6 for i, w in enumerate(words) for lang in range(2))
        huge = language_id.word_scores([long * 200, long * 100], finder, full)
        assert np.isfinite(huge).all() and (huge[0] < huge[1]).all()
        counts = language_id.expected([*words, long * 200], np.array([2.0, 1, 3, 1, 1, 1]), np.array([0, 1, 0, 1, 1, 0]), finder, full)
        spelled = np.array([len(n) for n in names])
        assert abs((counts[: len(names), 0] * spelled).sum() - (2 * 61 + 3 * 33 + 3001)) < 1e-3 and abs(counts[-1, 0] - 3) < 1e-6
        assert abs((counts[: len(names), 1] * spelled).sum() - (61 + 2 + 16)) < 1e-3


def test_language_sample_is_of_each_language(spark, monkeypatch):
    data = [(i, "der die das und", "de", "s", 0) for i in range(3000)] + [(5000 + i, "le la les des", "fr", "s", 0) for i in range(3)]
    langs, _, _ = language_id.learn(spark.createDataFrame(data, SCHEMA), PIECES, most=20, rounds=1)
    assert langs == ["de", "fr"]
    first = spark.createDataFrame(data, SCHEMA).filter("lang = 'de'").orderBy(F.xxhash64("doc_id")).limit(20).count()
    kept, keep = {}, language_id.materialise
    monkeypatch.setattr(language_id, "materialise", lambda df, label: kept.setdefault(label, keep(df, label)))
    language_id.learn(spark.createDataFrame(data, SCHEMA), PIECES, most=20, rounds=0)
    sizes = {r["lang"]: r["count"] for r in kept["language-sample"].groupBy("lang").count().collect()}
    assert sizes == {"de": first, "fr": 3}


def test_language_id_on_held_out_texts(spark):
    rnd = random.Random(1)
    kinds = {"en": "the and of that with this from have were which their would".split(), "de": "und der die das nicht mit auch eine werden schön über für".split(), "fr": "le la les des une que pour dans être avec où était".split()}
    data = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        data.append((i, " ".join(rnd.choice(kinds[lang]) for _ in range(30)), lang if i % 7 else None, "s", 0))
    data += [(900, None, "en", "s", 0), (901, "123 ... ²", "de", "s", 0), (902, "", None, "s", 0), (903, "x" * 3000, None, "s", 0)]
    out = {r["doc_id"]: r for r in language_id.held_out(spark.createDataFrame(data, SCHEMA).repartition(3), PIECES).collect()}
    assert len(out) == len(data)
    test = [i for i in range(240) if out[i]["held_out"]]
    assert sum(out[i]["lang_pred"] == sorted(kinds)[i % 3] for i in test) >= 0.97 * len(test)
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] in kinds
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.held_out(empty(spark), PIECES).count() == 0


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    aim, free, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not full:
            aim |= {s: level * w[s] for s in free}
            break
        aim |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2.0 * sizes[s] for s in full)
        free -= full
    return aim


def test_mixing_meets_its_targets(spark):
    df = docs(spark, clash=True)
    out = mixing.taken(df).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in mixing.taken(df.repartition(7)).collect()}
    by = {r[0]: r for r in rows()}
    sizes, took = Counter(), Counter()
    for r in out:
        assert r["size"] == len(WORD.findall(by[r["doc_id"]][1] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[by[r["doc_id"]][3]] += r["size"]
        took[by[r["doc_id"]][3]] += r["taken"]
    aim = brute_targets(dict(sizes))
    for r in out:
        s = by[r["doc_id"]][3]
        assert r["source_size"] == sizes[s] and abs(r["target"] - aim[s]) < 1e-6 * max(1, aim[s]) and abs(took[s] - aim[s]) <= 1
    assert mixing.taken(empty(spark)).count() == 0


def test_targets_of_sources_that_tie(spark):
    for sizes in ({"a": 250, "b": 100}, {f"s{k:02}": 100 for k in range(20)}, {"a": 250, "b": 100, "c": 50, "d": 250, "e": 9000, None: 50}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got, aim = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}, brute_targets(sizes)
        assert got.keys() == aim.keys() and all(abs(got[s] - aim[s]) < 1e-6 * max(1, aim[s]) for s in aim)
        assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_mixing_deals_disjoint_blocks(spark):
    _, pieces = mixing.mix_sources(docs(spark), blocks=64, depth=2)
    found = pieces.collect()
    shards = Counter()
    spans = {}
    for p in found:
        assert p["words"] > 0 and 0 <= p["shard"] < 4
        shards[p["shard"]] += p["words"]
        spans.setdefault((p["doc_id"], p["copy"]), []).append((p["first_word"], p["words"]))
    for own in spans.values():
        own.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:]))
    assert max(shards.values()) < 1.5 * min(shards.values())


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 250), (3, 1), (4, 0)], "source_key long, n_blocks long")
    out = mixing.split_quotas(quotas, 3).collect()
    total, per = Counter(), Counter()
    for r in out:
        total[r["source_key"]] += r["n"]
        per[r["shard"]] += r["n"]
    assert total == {1: 700, 2: 250, 3: 1} and max(per.values()) - min(per.values()) <= 1
    share = [r["n"] / per[r["shard"]] for r in out if r["source_key"] == 1]
    assert all(0.6 < x < 0.87 for x in share)


@pytest.mark.parametrize("case", [(300, 1000, 400), (5, 9, 4), (1, 50, 1), (40, 40, 13), (0, 7, 3), (700, 1000, 999)])
def test_hypergeometric_draws(spark, case):
    from math import comb

    marked, blocks, places = case
    n = 20_000
    frame = spark.range(n).select(*[F.lit(x).cast("long").alias(c) for c, x in zip("mbp", case)], ((F.col("id") + 0.5) / n).alias("u"))
    got = Counter(r[0] for r in frame.selectExpr(mixing.hypergeometric("m", "b", "p", "u")).collect())
    assert sum(got.values()) == n
    for k in range(0, marked + 1):  # u goes over [0, 1) evenly, so counts are as exact as the grid
        want = comb(marked, k) * comb(blocks - marked, places - k) / comb(blocks, places) if 0 <= places - k <= blocks - marked else 0.0
        assert abs(got[k] - n * want) <= 2


def test_splitting_tree_of_many_sources(spark):
    """More sources than a row may hold go in groups; quotas and shards stay exact."""
    quotas = spark.range(200).select(F.col("id").alias("source_key"), (F.col("id") % 7).alias("n_blocks"))
    out = mixing.split_quotas(quotas, 3, group_sources=8).collect()
    total, per = Counter(), Counter()
    for r in sorted(out, key=lambda r: r["shard"]):
        assert r["first"] == total[r["source_key"]]
        total[r["source_key"]] += r["n"]
        per[r["shard"]] += r["n"]
    assert total == {k: k % 7 for k in range(200) if k % 7} and len(per) == 8 and max(per.values()) - min(per.values()) <= 1


def test_blocks_are_drawn_once_and_permuted(spark):
    quotas = spark.createDataFrame([(1, 700), (2, 31), (3, 1), (4, 0)], "source_key long, n_blocks long")
    first, second = (mixing.drawn_blocks(quotas, 3, seed).collect() for seed in (1, 2))
    for out in (first, second):
        assert sorted((r["source_key"], r["block"]) for r in out) == [(s, b) for s, n in ((1, 700), (2, 31), (3, 1)) for b in range(n)]
    assert {tuple(r) for r in first} != {tuple(r) for r in second}


def test_mixing_takes_what_the_tree_deals(spark, monkeypatch):
    df = docs(spark)
    plain = {r["doc_id"]: r for r in mixing.taken(df).collect()}
    assert all(sum(s["words"] for s in r["shards"]) == r["taken"] for r in plain.values())
    assert len({s["shard"] for r in plain.values() for s in r["shards"]}) == 8
    draw = mixing.drawn_blocks
    monkeypatch.setattr(mixing, "drawn_blocks", lambda quotas, depth, seed: draw(quotas, depth, seed + 1))
    other = {r["doc_id"]: r for r in mixing.taken(df).collect()}
    assert any(plain[i]["shards"] != other[i]["shards"] for i in plain) and all(plain[i]["taken"] == other[i]["taken"] for i in plain)
    monkeypatch.setattr(mixing, "drawn_blocks", lambda quotas, depth, seed: draw(quotas, depth, seed).filter("shard <> 3"))
    fewer = {r["doc_id"]: r for r in mixing.taken(df).collect()}
    assert sum(r["taken"] for r in fewer.values()) < sum(r["taken"] for r in plain.values())


def test_mixing_scales_its_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    _, pieces = mixing.mix_sources(docs(spark))
    sums = [r["sum"] for r in pieces.groupBy("shard").agg(F.sum("words").alias("sum")).collect()]
    assert len(sums) > 8 and max(sums) <= 1.2 * 500


def test_mixing_gives_repeated_rows_their_own_share(spark, tmp_path):
    data = rows(n=30)
    data += [data[0]] * 40 + [(None, "a b c", "en", "s1", 5)] * 3
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = mixing.taken(df).collect()
    took, aim = Counter(), {}
    source = {r[0]: r[3] for r in data}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[source[r["doc_id"]]] += r["taken"]
        aim[source[r["doc_id"]]] = r["target"]
    assert len(out) == len(data) and all(abs(took[s] - aim[s]) <= 1 for s in aim)
    df = df.filter("doc_id is not null")
    _, pieces = mixing.mix_sources(df)
    mixing.write_mix(df, pieces, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == pieces.agg(F.sum("words")).first()[0]


def test_write_mix(spark, tmp_path):
    df = docs(spark)
    _, pieces = mixing.mix_sources(df)
    mixing.write_mix(df, pieces, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == pieces.agg(F.sum("words")).first()[0]


def test_lines_and_words_that_only_share_a_hash_are_different(spark):
    a, b = "flmijlfpaqbmhngz", "imshxixoBJXq3JdZ"
    texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", f"x {a} y x {b} y", f"x {a} y x {a} y"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.apply_rules(df, labels(spark)).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (0, 6)}
