"""Archives, revisits and the merged index against brute force."""

import base64
import hashlib
import os
import random

from tidewall.llm.warc import LoserTree, archive_pages, parse_archive, url_key, write_archives


def test_round_trip_and_order(spark, tmp_path):
    rng = random.Random(3)
    pages = [(i, f"http://{rng.choice('abc')}.example.com/{rng.randint(0, 9)}?b=2&a=1", rng.choice(["<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>", "same", f"own {i}", "", None, "x" * 5000])) for i in range(120)]
    pages += [(500, None, "same"), (501, "no host\r\nEvil: 1", "é\u2028"), (3, "http://dup.example.com/", "own dup")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, captured string").repartition(4)
    rows = archive_pages(df).collect()
    assert len(rows) == len(pages)
    least = {}
    for i, _, html in pages:
        least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, _, html in pages:
        data, first = (html or "").encode(), least[html or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if i != first else "response", first if i != first else None))
    key = lambda r: (r[0], r[2])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key) == sorted(want, key=key)
    ordered = sorted(rows, key=lambda r: (r.merge_range, r.merge_position))
    assert [(r.url_key, r.captured, r.page_id) for r in ordered] == sorted((r.url_key, r.captured, r.page_id) for r in rows)


def test_ranges_follow_each_other(spark):
    from tidewall.llm.common import shared_dir, stored
    from tidewall.llm.warc import merge_index, read_captures

    df = spark.createDataFrame([(i, f"http://{'hot' if i % 3 else i}.com/", f"p{i}") for i in range(400)], "page_id long, url string, html string").repartition(6)
    path = shared_dir(spark, "warc")
    write_archives(df, path, records_per_file=20)
    rows = merge_index(stored(read_captures(spark, path), "captures"), range_rows=25).collect()
    ordered = sorted(rows, key=lambda r: (r.merge_range, r.merge_position))
    assert len({r.merge_range for r in rows}) > 4
    assert [(r.url_key, r.captured) for r in ordered] == sorted((r.url_key, r.captured) for r in rows) and len({r.page_id for r in rows}) == 400


def test_small_payloads_are_not_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (None, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {(r.page_id, r.record_type) for r in archive_pages(df, least_bytes=3).collect()}
    assert got == {(1, "response"), (2, "response"), (None, "response"), (4, "response")}
    assert archive_pages(df.filter("page_id = 9")).count() == 0


def test_any_id_and_rows_that_repeat(spark):
    ids = [2**62, -(2**62), 10**12, 0, -5, None, None, 7, 7, 7]
    pages = [(i, "http://a.com/", "same" if k % 2 else f"p{k}") for k, i in enumerate(ids)] + [(11, "http://a.com/x", "rep")] * 300
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = archive_pages(df).collect()
    assert len(rows) == len(pages)
    assert sum(r.page_id == 11 and r.record_type == "response" for r in rows) == 300
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows if r.page_id in (2**62, -(2**62), 7)} == {(2**62, "response", None), (-(2**62), "response", None), (7, "response", None), (7, "revisit", -(2**62))}
    ordered = sorted(rows, key=lambda r: (r.merge_range, r.merge_position))
    key = lambda r: (r.url_key, r.captured, r.page_id is not None, r.page_id or 0)
    assert [key(r) for r in ordered] == sorted(map(key, rows))


def test_archives_are_bounded_and_records_named_once(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, "u", "x" * 2000 + str(i % 40)) for i in range(200)], "page_id long, url string, html string")
    path = f"{tmp_path}/warc"
    write_archives(df, path, archive_bytes=50_000)
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    heads = [h for f in files for h, _ in parse_archive(open(f"{path}/{f}", "rb").read())]
    assert len(files) > 3 and len({h["warc-record-id"] for h in heads}) == 200
    assert {h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"} <= {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("HTTP://www.A.Example.com/B/?z=1&a=2#f") == "com,example,a)/b?a=2&z=1"
    assert url_key(None) == url_key("nope") == "" and url_key("x://h?q") == "h)/"
    assert list(parse_archive(b"")) == []
