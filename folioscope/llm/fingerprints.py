"""Document fingerprints: quartile digests of hashed byte triplets.

Three triplets are taken at every byte from the five bytes that start there; each is
hashed into one of 256 buckets.  The digest holds the text's length on a logarithmic
scale, two quartile ratios, and for each bucket in which quarter of the bucket counts
its own count lies.  Two digests differ by the sum of their bucket distances (the
extremes count double) and header distances, bounded by ``MOST``; likeness is one minus
the share of that bound.

Defined results: null reads as the empty text; texts of under five bytes have no
triplets and differ by length only; equal texts have equal digests.  Very long texts are
digested whole.  Rows of equal ids are ordered by text, and repeated rows follow each
other; a null id is the least.  An empty table gives an empty result; ``fingerprint`` keeps
other columns and replaces one of its own name, the pairs ignore other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: About the difference of independent digests: 256 buckets of 1.625 each.
MOST = 416
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
_PASS_BYTES = 1 << 20


def digests(texts: list[bytes]) -> np.ndarray:
    """One row per text: length code, two ratios, then 256 quartile codes."""
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and to - at < 512 and size + len(texts[to]) <= _PASS_BYTES:
            size += len(texts[to])
            to += 1
        out[at:to] = _digests(texts[at:to])
        at = to
    return out


def _digests(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    if len(data) >= 5:
        n = len(data) - 4
        inside = owner[:n] == owner[4:]
        base = (owner[:n] * BUCKETS)[inside]
        for k, (a, b, c) in enumerate(_TRIPLETS):
            h = data[a : n + a] * np.uint32(0x9E3779B1) ^ data[b : n + b] * np.uint32(0x85EBCA77) ^ data[c : n + c] * np.uint32(0xC2B2AE3D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F + 2 * k)
            counts += np.bincount(base + (h >> np.uint32(24))[inside], minlength=len(counts))
    counts = counts.reshape(-1, BUCKETS)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * j // 4 - 1] for j in (1, 2, 3))
    out = np.empty((len(texts), 3 + BUCKETS), np.uint8)
    out[:, 0] = np.minimum(np.round(np.log1p(sizes) / np.log(1.1)), 255)
    out[:, 1] = 15 * q1 // np.maximum(q3, 1)
    out[:, 2] = 15 * q2 // np.maximum(q3, 1)
    out[:, 3:] = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    return out


def to_text(rows: np.ndarray) -> list[str]:
    """134 hexadecimal digits: length, ratios, then four buckets a byte."""
    codes = rows[:, 3:].reshape(len(rows), -1, 4)
    packed = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
    return [r.tobytes().hex() for r in np.concatenate([rows[:, :3], packed], axis=1).astype(np.uint8)]


def from_text(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.concatenate([raw[:3], (raw[3:, None] >> np.array([6, 4, 2, 0]) & 3).reshape(-1)]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 (``MOST`` or more apart) to 1 (equal digests), row by row."""
    apart = np.abs(a.astype(np.int64) - b.astype(np.int64))
    body = apart[:, 3:]
    return 1.0 - np.minimum(body.sum(axis=1) + 3 * (body == 3).sum(axis=1) + apart[:, :3].sum(axis=1), MOST) / MOST


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint``."""
    kept = [c for c in df.columns if c != "fingerprint"]
    schema = df.select(*kept).withColumn("fingerprint", F.lit("")).schema
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = digests([(t or "").encode() for t in batch.column(n).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(to_text(rows), pa.string())], schema.names)

    return df.select(*kept, df[text].alias("__text")).mapInArrow(run, schema)


_LEAST = -(1 << 63)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (dest, guest, id, text) in which each document is followed by the next.

    Documents are dealt into ranges of descending id by boundaries from a quantile sketch;
    the first document of each range also goes to the end of the range before (that of the
    first range to the end of the last), marked ``guest``.  One shuffle; no task holds the
    whole order, and the driver holds a boundary and a head per range.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("v"))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.select("v").agg(F.percentile_approx("v", shares, 10_000).alias("q")).first()["q"] if shares else []
    bounds = np.unique(np.array(found or [], np.int64))

    def dest_of(v: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, v, side="left")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            v = batch.column(0).to_numpy()
            dest = dest_of(v)
            for d in np.unique(dest).tolist():
                best[d] = max(best.get(d, _LEAST), int(v[dest == d].max()))
        yield pa.RecordBatch.from_pydict({"dest": pa.array(list(best), pa.int32()), "head": pa.array(list(best.values()), pa.int64())})

    head_of = dict(sorted(tuple(r) for r in rows.select("v").mapInArrow(heads, "dest int, head long").groupBy("dest").agg(F.max("head")).collect()))
    order = list(head_of)
    guests = {head_of[d]: order[i - 1] for i, d in enumerate(order)}
    guest_ids = np.array(sorted(guests), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dest", "guest", "doc_id", "v", "text"]
        for batch in batches:
            v = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(dest_of(v), pa.int32()), pa.array(np.zeros(len(v), bool)), batch.column(0), batch.column(2), batch.column(1)], names)
            also = np.flatnonzero(np.isin(v, guest_ids))
            if len(also):
                part = batch.take(pa.array(also))
                yield pa.RecordBatch.from_arrays([pa.array([guests[x] for x in v[also].tolist()], pa.int32()), pa.array(np.ones(len(also), bool)), part.column(0), part.column(2), part.column(1)], names)

    dealt = rows.select("doc_id", "text", "v").mapInArrow(deal, "dest int, guest boolean, doc_id long, v long, text string")
    return dealt.repartitionById(ranges, F.pmod(F.col("dest"), F.lit(ranges))).sortWithinPartitions("dest", "guest", F.desc("v"), "text")


def edited_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest next to its edited text's and the next document's.

    The edited text has the last floor(n / 2) of n code points replaced by the first as
    many (or all) of the next document in descending id (rows of equal ids: by text; null
    ids: last).  Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # (dest, id, text) that waits for its next

        def emit(pairs: list[tuple]) -> pa.RecordBatch:
            own, edited = [], []
            for _, mine, other in pairs:
                half = len(mine) // 2
                own.append(mine.encode())
                edited.append((mine[: len(mine) - half] + other[:half]).encode())
            a, b, c = digests(own), digests(edited), digests([p[2].encode() for p in pairs[-1:]])
            follows = np.concatenate([a[1:], c])
            # Within a range the next row's own text is this row's next; only its last pair differs.
            for i, (x, y) in enumerate(zip(pairs[:-1], pairs[1:], strict=True)):
                if x[2] is not y[1] and x[2] != y[1]:
                    follows[i] = digests([x[2].encode()])[0]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([len(p[1]) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array(to_text(a)),
                    pa.array(to_text(b)),
                    pa.array(likeness(a, b)),
                    pa.array(likeness(a, follows)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        pairs: list[tuple] = []
        size = 0
        for batch in batches:
            for dest, guest, key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if before is not None and before[0] == dest:
                    pairs.append((before[1], before[2], text))
                    size += len(text)
                before = None if guest else (dest, key, text)
                if size > _PASS_BYTES or len(pairs) >= 512:
                    yield emit(pairs)
                    pairs, size = [], 0
        if pairs:
            yield emit(pairs)

    return with_next(df, doc_id, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
