import base64
import hashlib
import heapq
import random

import pytest

from folioscope.llm import warc as W

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([f"http://www.a{i % 4}.example.com/x/{i % 3}?q=1#f", "https://b.org", None, "no url\r\nX: y"]), rng.choice(["<p>a</p>", "", None, "é" * 50, f"own {i}"])) for i in range(80)]
    return spark.createDataFrame(rows + [(None, None, None)], SCHEMA).repartition(3)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 12))) for i in range(k)]
    assert list(W.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(pages, least):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    last = {}
    for i, p in rows:
        if i is not None:
            last[p] = max(last.get(p, i), i)
    want = set()
    for i, p in rows:
        response = len(p) < least or i == last.get(p)
        want.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else last[p]))
    got = W.archive_and_read(pages, least).collect()
    assert {tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got} == want and len(got) == len(rows)


def test_global_order(pages):
    got = W.merge_histories(W.write_runs(W.plan_records(pages)), read=False).orderBy("shard", "position").collect()
    keys = [(r["url_key"], r["ts"]) for r in got]
    assert keys == sorted(keys) and len(keys) == pages.count()


def test_keys_and_odd_tables(spark):
    df = spark.createDataFrame([("http://www.A.example.COM:80/P?q#f",), ("https://u@b.org",), ("odd",), (None,)], "url string")
    assert [r[0] for r in df.select(W.url_key(df["url"])).collect()] == ["com,example,a)/p?q", "org,b)/", "odd", ""]
    empty = spark.createDataFrame([], SCHEMA)
    assert W.archive_and_read(empty).count() == 0
    from pyspark.sql import functions as F

    extra = spark.createDataFrame([(1, "u", "h")], SCHEMA).withColumns({"ts": F.lit(1), "sha1": F.lit(2), "size": F.lit(3), "path": F.lit(4)})
    assert W.archive_and_read(extra).first()["payload_bytes"] == 1


def test_repeated_ids_and_hot_payload(spark):
    """Rows that share the response's id are all responses; a payload of most pages is one response."""
    rows = [(9, "https://a.org/", "same"), (9, "https://b.org/", "same"), (1, "https://a.org/", "same")] + [(100 + i, f"https://h{i % 3}.org/{i}", "error page") for i in range(200)]
    got = W.archive_and_read(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] < 100) == [(1, "revisit", 9), (9, "response", None), (9, "response", None)]
    assert [r["page_id"] for r in got if r["page_id"] >= 100 and r["record_type"] == "response"] == [299]
    assert all(r["refers_to"] == 299 for r in got if 100 <= r["page_id"] < 299)
