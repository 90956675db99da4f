import base64
import hashlib
import random

import pytest

from ligature.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages():
    rnd = random.Random(4)
    texts = ["", None, "same", "é" * 300, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb", "x\r\n\r\n", "\r\n\r\n", " \x85\x0b"]
    out = [(i, f"http://{rnd.choice(['a.example.org', 'www.b.example.com:80', 'u@c.net'])}/p{rnd.randint(0, 9)}?q={i % 2}#f", texts[i % 8] if i % 3 else f"page {i}") for i in range(200)]
    out += [(500, None, "same"), (501, "no url at all", "z"), (502, "http://h", "a\nb"), (503, "http://h?x", "y" * 300000), (504, "http://l\r\nX: y/", "q"), (505, "", "w")]
    return out + [(-3, "http://a.example.org/p1", "page 0"), (None, "http://n", "page 0"), (None, "http://n", "alone"), (7, out[7][1], out[7][2]), (7, out[7][1], out[7][2]), (8, "http://twice", "another"), (600, out[0][1], "late")]


def brute(data, least=0):
    first = {}
    for i, _, html in data:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, url, html in data:
        raw = (html or "").encode()
        to = first.get(html or "") if len(raw) >= least else None
        again = to is not None and to != i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def frame(spark, data, clash=False):
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return df.selectExpr("*", "1L as first", "2 as n", "'c' as check", "'p' as payload", "3L as position") if clash else df


@pytest.mark.parametrize("clash", [False, True])
def test_archives_by_brute_force(spark, clash):
    out = warc.digest(frame(spark, pages(), clash)).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(pages())
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    times = {i: i % (1 << 31) for i, *_ in pages() if i is not None} | {None: 0}
    keys = [(r["url_key"], times[r["page_id"]], r["page_id"] is None, r["page_id"] or 0) for r in sorted(out, key=lambda r: r["position"])]
    assert keys == sorted(keys)


def test_small_payloads_are_responses(spark, tmp_path):
    warc.write_archives(frame(spark, pages()), str(tmp_path / "w"), least=5)
    out = warc.read_archives(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(pages(), 5)


def test_payloads_come_back_whole(spark, tmp_path):
    warc.write_archives(frame(spark, pages()), str(tmp_path / "w"), archive_bytes=20000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 8
    out = [(r["page_id"], (r["url"] or "").replace("%0D", "\r").replace("%0A", "\n"), r["payload"].decode()) for r in warc.payloads(spark, str(tmp_path / "w")).collect()]
    assert sorted(out, key=str) == sorted(((i, u or "", h or "") for i, u, h in pages()), key=str)


def test_a_hot_url_in_small_ranges(spark, tmp_path, monkeypatch):
    data = [(i, "http://hot/" if i % 3 else f"http://cold/{i}", "p") for i in range(3000)]
    warc.write_archives(frame(spark, data), str(tmp_path / "w"), archive_bytes=100_000)
    index = warc.read_archives(spark, str(tmp_path / "w"))
    rows = warc.merged(index, range_rows=100).orderBy("position").collect()
    assert [(r["url_key"], r["page_id"]) for r in rows] == sorted((warc.url_key(u), i) for i, u, _ in data)
    assert [r["position"] for r in rows] == list(range(3000))


def test_archives_are_standard_records(spark, tmp_path):
    warc.write_archives(frame(spark, [(1, "http://h/", "<p>é</p>"), (2, "http://h/", "<p>é</p>")]).coalesce(1), str(tmp_path / "w"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest())
    assert text.count(b"WARC/1.1\r\n") == 2 and b"WARC-Payload-Digest: sha1:" + digest + b"\r\n" in text
    assert b"WARC-Date: 2024-01-01T00:00:01Z\r\n" in text and b"WARC-Refers-To: <urn:capture:1:" in text
    broken = tmp_path / "b"
    broken.mkdir()
    (broken / "part-0").write_bytes(text.replace(b"<p>", b"<q>"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, str(broken)).collect()
    (broken / "part-0").write_bytes(text[:-9])
    with pytest.raises(Exception, match="no whole record"):
        warc.read_archives(spark, str(broken)).collect()


def test_given_times_and_empty_tables(spark, tmp_path):
    df = spark.sql("select 1L as page_id, 'http://h/' as url, 'x' as html, timestamp'1999-12-31 23:59:59Z' as t union all select 2L, 'http://h/', 'y', null")
    warc.write_archives(df, str(tmp_path / "w"), time="t")
    assert sorted(r["captured"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == ["1999-12-31T23:59:59Z", "2024-01-01T00:00:00Z"]
    assert warc.digest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randint(0, 30),) for _ in range(rnd.randint(0, 20))) for _ in range(k)]
    out = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in out] == sorted(x for run in runs for x in run)
    assert len(set(out)) == sum(map(len, runs))
