import hashlib

import numpy as np

from folioscope.llm import fingerprints as P


def reference_digest(raw):
    counts = [0] * P.BUCKETS
    m = 0xFFFFFFFF
    for i in range(len(raw) - 4):
        for k, (a, b, c) in enumerate(P._TRIPLETS):
            h = (raw[i + a] * 0x9E3779B1 & m) ^ (raw[i + b] * 0x85EBCA77 & m) ^ (raw[i + c] * 0xC2B2AE3D & m)
            h = (h ^ h >> 15) * (0x27D4EB2F + 2 * k) & m
            counts[h >> 24] += 1
    ordered = sorted(counts)
    q = [ordered[P.BUCKETS * j // 4 - 1] for j in (1, 2, 3)]
    return [min(round(np.log1p(len(raw)) / np.log(1.1)), 255), 15 * q[0] // max(q[2], 1), 15 * q[1] // max(q[2], 1), *(sum(c > x for x in q) for c in counts)]


def test_digests(rows):
    texts = [(r[1] or "").encode() for r in rows]
    made = P.digests(texts)
    for t, row in zip(texts[::4], made[::4], strict=True):
        assert row.tolist() == reference_digest(t)
    assert all((P.from_text(x) == r).all() for x, r in zip(P.to_text(made), made, strict=True))
    assert P.likeness(made, made).min() == 1.0


def test_edited_pairs(unique_docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in unique_docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in P.edited_pairs(unique_docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = P.digests([text.encode(), edited.encode(), after.encode()])
        assert r["fingerprint"] == P.to_text(a[None])[0] and r["edited_fingerprint"] == P.to_text(b[None])[0]
        assert abs(r["near_edited"] - P.likeness(a[None], b[None])[0]) < 1e-12
        assert abs(r["near_next"] - P.likeness(a[None], c[None])[0]) < 1e-12


def test_odd_tables(docs, none, clashing, spark):
    assert P.edited_pairs(docs).count() == docs.count()  # repeated and null ids
    assert P.edited_pairs(none).count() == 0
    assert P.fingerprint(clashing).count() == clashing.count()
    one = P.edited_pairs(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
