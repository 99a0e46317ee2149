import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import suffix_repeats as S


def brute(texts, size):
    seen = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def check(df, size=60):
    got = df.select("doc_id", "text")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in got.collect()]
    want = sorted(((str(i), len(t), k) for (i, t), k in zip(rows, brute([t for _, t in rows], size), strict=True)))
    made = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in S.remove_repeats(df, size).collect())
    assert made == want


@pytest.mark.parametrize("many", [2000, 0])
def test_against_brute_force(docs, many, monkeypatch):
    monkeypatch.setattr(S, "MANY_REGIONS", many)  # 0: all anchors are split
    check(docs)


def test_groups_cover_what_repeats(unique_docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in unique_docs.collect()}
    rows = S.repeat_groups(unique_docs, 60).collect()
    strings, marks = {}, {i: bytearray(len(t)) for i, t in texts.items()}
    for r in rows:
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] >= 60 and strings.setdefault(r["group_id"], part) == part
        marks[r["doc_id"]][r["start"] : r["start"] + r["length"]] = b"\1" * r["length"]
    ids = [i for i in texts if i != 67]  # a run of one character
    for i, kept in zip(texts, brute(list(texts.values()), 60), strict=True):
        if i in ids:
            assert bytes(b for b, m in zip(texts[i], marks[i], strict=True) if not m) == kept


def test_empty_and_clashing(none, clashing):
    assert S.remove_repeats(none, 60).count() == 0
    check(clashing)


def test_runs_of_one_character(spark):
    check(spark.createDataFrame([(1, "a" * 500), (2, "b" + "a" * 59), (3, "c" * 70), (4, "ab" * 100)], "doc_id long, text string"))


@pytest.mark.parametrize("seed", range(5))
def test_maximal_repeats(seed):
    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 99, rng.integers(5, 40)).astype(np.uint8)) for _ in range(6)]
    array = S.SuffixArray(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))
    suffixes = [(t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t))]
    starts = np.cumsum([0] + [len(t) for t in texts])
    assert [suffixes_text(texts, starts, p) for p in array.order] == sorted(s for s, _, _ in suffixes)
    groups = {}
    for length, at in array.repeats(4):
        groups[suffixes_text(texts, starts, at[0])[:length]] = sorted(at.tolist())
    want = {}
    for t in {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 4, len(t) + 1)}:
        places = [(k, i) for k, x in enumerate(texts) for i in range(len(x)) if x.startswith(t, i)]
        lefts = {texts[k][i - 1 : i] or k for k, i in places}
        rights = {texts[k][i + len(t) : i + len(t) + 1] or k for k, i in places}
        if len(places) > 1 and len(lefts) > 1 and len(rights) > 1:
            want[t] = sorted(int(starts[k]) + i for k, i in places)
    assert groups == want


def suffixes_text(texts, starts, p):
    k = int(np.searchsorted(starts, p, side="right")) - 1
    return texts[k][p - starts[k] :]


def test_hashes_of_two_letters(alike):
    check(alike, 400)
    check(alike.where("doc_id < 3"), 700)


@pytest.mark.parametrize("many", [2000, 0])
def test_long_repeats_are_one_group(spark, many, monkeypatch):
    """Repeats of many regions, one of them with a part that occurs once more; also when all anchors are split."""
    monkeypatch.setattr(S, "MANY_REGIONS", many)
    rng = np.random.default_rng(4)
    text = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    a, b, c = text(2500), text(1500), text(900)
    rows = [(1, text(300) + a + text(200)), (2, text(50) + a + text(80) + b), (3, b + text(700) + c[:400] + text(9)), (4, text(500) + c), (5, c + text(33)), (6, text(1000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = {}
    for r in S.repeat_groups(df, 60).collect():
        groups.setdefault((r["group_id"], r["length"]), []).append((r["doc_id"], r["start"]))
    texts = dict(rows)
    found = {texts[places[0][0]][places[0][1] :][:n]: sorted(places) for (_, n), places in groups.items()}
    assert all(texts[i][s:].startswith(t) for t, places in found.items() for i, s in places)
    assert found[a] == [(1, 300), (2, 50)] and found[b] == [(2, 2630), (3, 0)]
    assert sum(t in a for t in found) == 1 and sum(t in b for t in found) == 1
    assert max((len(t), places) for t, places in found.items() if t in c and len(places) == 3) == (400, [(3, 2200), (4, 500), (5, 0)])
    # What occurs in two places only begins where the third one's part ends, less one string.
    assert any(t in c and t.endswith(c[-1:]) and places == [(4, 500 + c.index(t)), (5, c.index(t))] for t, places in found.items())


def peak_of(call):
    call()  # tables that are kept
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_task():
    """What a Python worker holds: by byte of an array, by pass over texts, and by copy of a hot anchor's pieces."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 800).astype(np.uint8).tobytes() for _ in range(500)]
    texts += [t[:500] + t[:300] for t in texts]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(1001) * 800
    assert peak_of(lambda: S.SuffixArray(data, offsets)) < 60 * len(data)
    column = pa.array([t.decode() * 5 for t in texts])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), column], ["t", "text"])
    assert peak_of(lambda: [None for _ in S.region_batches(iter([batch]), 400)]) < 80 << 20


def test_copies_of_a_piece_are_one_string():
    rows = [(5, i, i, 16, False, b"x" * 416) for i in range(5000)] + [(5, 5000, 5000, 16, False, b"x" * 415 + b"y"), (6, 1, 2, 0, True, b"z" * 500)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], ["key", "h", "c", "off", "many", "data"]) for part in (rows[:3000], rows[2999:])]
    (held,) = S._arrays(iter(batches))
    assert held.data == [b"x" * 416, b"x" * 415 + b"y", b"z" * 500] and held.many.tolist() == [True, False, True]
    assert [(held.data[s], h, c, o) for s, h, c, o in zip(held.of, held.h, held.c, held.off, strict=True)] == [(r[5], *r[1:4]) for r in rows]
    places, at = held.places_of(np.array([2, 0, 2]))
    assert places.tolist() == [5001, *range(5000), 5001] and at.tolist() == [0] + [1] * 5000 + [2]


@pytest.mark.parametrize("many", [2000, 0])
def test_a_passage_of_many_texts(spark, many, monkeypatch):
    """Copies between texts that differ around it, also when its anchors are split and their equal pieces put together."""
    monkeypatch.setattr(S, "MANY_REGIONS", many)
    rng = np.random.default_rng(6)
    text = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage = text(210)
    rows = [(i, text(70) + passage[i % 3 :] + text(70)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df)
    whole = {(r["doc_id"], r["start"]) for r in S.repeat_groups(df, 60).collect() if dict(rows)[r["doc_id"]][r["start"] :][: r["length"]] == passage[2:]}
    assert whole == {(i, 72 - i % 3) for i in range(40)}
