import random
import re

import pytest

from folioscope.llm import _tables
from folioscope.llm import jaccard_join as J


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_against_brute_force(unique_docs, k, num):
    rows = [(r["doc_id"], r["text"]) for r in unique_docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(unique_docs, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_large_groups(spark, monkeypatch):
    """Near copies of few bases: large groups, leaders and nearest partners."""
    monkeypatch.setattr(J, "SMALL_GROUP", 3)
    rng = random.Random(4)
    rows = []
    for base in range(3):
        words = [f"w{base}x{rng.randrange(400)}" for _ in range(60)]
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_groups(df, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    df = spark.createDataFrame(links, "u long, v long")
    one = {tuple(r) for r in _tables.connected_components(df).collect()}
    monkeypatch.setattr(_tables, "ONE_TASK_LINKS", 0)
    many = {tuple(r) for r in _tables.connected_components(df).collect()}
    loops = {(a, a) for a, b in links if a == b}
    assert many - loops == {(n, c) for n, c in one if (n, c) not in loops or (n, c) in many} - loops
    assert {c for n, c in many if n <= 30} == {0}


def test_odd_tables(docs, none, clashing):
    assert J.similar_groups(none).count() == 0
    got = J.similar_groups(docs).collect()
    assert len(got) == docs.count() and {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    kept = J.drop_near_duplicates(clashing)
    assert kept.columns and kept.where("doc_id = 5").count() == 1


def test_hashes_of_long_words(alike):
    got = {r["doc_id"]: r["component_id"] for r in J.similar_groups(alike, 3, 90, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
