import re

import pytest

from folioscope.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=13):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - window + 1)) if x else ():
            part = x[k : k + window]
            for p in range(len(w) - len(part) + 1):
                if w[p : p + len(part)] == part:
                    hit.update(range(p, p + len(part)))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_against_brute_force(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)  # 60: several blocks
    long = rows[7][1].replace("\n", " ! ")
    items = [(1, long), (2, rows[60][1].upper()), (3, "a"), (4, None), (5, " -- "), (10, rows[3][1].split("\n")[0]), (None, "日本語 é"), (6, long), (7, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items), r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["hits"]) == r["n_hit"]


def test_odd_tables(spark, none, docs, clashing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in D.find_contamination(docs, empty).collect()} == {0}
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert D.find_contamination(none, bench).count() == 0
    out = D.find_contamination(clashing, bench)
    assert dict(out.dtypes)["items"] == "array<string>" and out.count() == clashing.count()
