"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text, with
every non-letter read as a space.  A feature's value is its share of the text's n-grams
times its inverse document frequency; the frequencies come from all labelled documents
that training may use.  Weights are learned by follow-the-regularised-leader with
elastic-net penalties on a bounded sample (``MAX_SAMPLE`` documents in equal parts per
label, chosen by hash, of at most ``MAX_SAMPLE_CHARS`` characters each); a fifth of the
sample is set apart to fit the temperature of the softmax.

Prediction reads whole texts and nothing but the text: per n-gram one table look-up, and
sums per document; no shuffle.  The model has a fixed size.

Defined results: a null text, or one without a letter, is ``und`` with score 0; documents
with a null label or id are not learned from; without any usable label every prediction
is ``und``; ties go to the first label in order; rows are independent, so repeated rows
get equal results; very long texts are predicted whole, and learned from by their first
``MAX_SAMPLE_CHARS`` characters where a label has few short ones; an empty table gives an
empty result; other columns are kept, and one named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import chunks, in_share

BITS = 15
SLOTS = 1 << BITS
ORDERS = 3
MAX_SAMPLE = 6000
MAX_SAMPLE_CHARS = 20_000
#: Documents of at most that length from which a label is learned from them alone.
MIN_SHORT = 20
UNKNOWN = "und"
_SCALE = 100.0
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order the slot of the n-gram at each character (SLOTS: none), text starts, letters per text.

    Each text is followed by one character of its own, so no segment is empty.
    """
    column = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(column, "")), "", "\n")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "")[0].as_py()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    starts = np.cumsum(sizes) - sizes
    codes = np.where(letter, points, np.uint32(32)) * np.uint32(0x9E3779B1)
    room = np.repeat(starts + sizes - 1, sizes) - np.arange(len(points))  # characters up to the text's end
    slots, h = [], codes
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        slot = np.full(len(points), SLOTS, np.int32)
        slot[: len(h)] = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        slot[room < n] = SLOTS
        slots.append(slot)
    return slots, starts, np.add.reduceat(letter.astype(np.int64), starts) if len(starts) else starts


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (SLOTS + 1, labels): inverse document frequency times weight; the last row is zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits and letters per text."""
        slots, starts, letters = grams(column)
        total = np.zeros((len(starts), len(self.labels)))
        counts = np.zeros(len(starts))
        for slot in slots:
            total += np.add.reduceat(self.weights[slot], starts, axis=0)
            counts += np.add.reduceat((slot < SLOTS).astype(np.int64), starts)
        return self.bias + _SCALE * total / np.maximum(counts, 1)[:, None], letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.labels or len(column) == 0:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        logits, letters = self.logits(column)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return [self.labels[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, p.max(axis=1), 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all the documents each slot occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for a, b in chunks(batch.column(0), 1 << 20):
                for at in range(a, b, 256):
                    column = batch.column(0).slice(at, min(256, b - at))
                    slots, starts, _ = grams(column)
                    seen = np.zeros((len(column), SLOTS + 1), bool)
                    row = np.repeat(np.arange(len(column)), np.diff(np.append(starts, len(slots[0]))))
                    for slot in slots:
                        seen[row, slot] = True
                    found += seen.sum(axis=0)
                    n += len(column)
        some = np.flatnonzero(found[:SLOTS])
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(found[some], n))})

    out, n = np.zeros(SLOTS, np.int64), 0
    for slot, count in docs.select(text).mapInArrow(run, "slot int, n long").groupBy("slot").sum("n").collect():  # SLOTS rows at most
        if slot < 0:
            n = count
        else:
            out[slot] = count
    return out, n


def train(texts: list[str], labels: list[str], frequencies: np.ndarray, n_documents: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001, epochs: int = 3, apart: int = 5) -> Model:
    """FTRL-proximal on the sample, then the temperature on every ``apart``-th text."""
    names = sorted(set(labels))
    k = len(names)
    if k == 0:
        return Model([], np.zeros((SLOTS + 1, 0)), np.zeros(0))
    target = np.array([names.index(x) for x in labels])
    idf = np.log((1.0 + n_documents) / (1.0 + frequencies)) + 1.0
    rows = []
    for t in texts:
        slots, _, _ = grams(pa.array([t], pa.string()))
        found = np.concatenate(slots)
        at, counts = np.unique(found[found < SLOTS], return_counts=True)
        rows.append((at.astype(np.int32), (_SCALE * counts / max(1, counts.sum()) * idf[at]).astype(np.float32)))
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))  # the last slot is the bias

    def solve(at: np.ndarray) -> np.ndarray:
        pull = z[at]
        return np.where(np.abs(pull) <= l1, 0.0, -(pull - np.sign(pull) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    fit = np.array([i for i in range(len(rows)) if i % apart], np.int64) if len(rows) > apart * k else np.arange(len(rows))
    for _ in range(epochs):
        for i in order.permutation(fit).tolist():
            at, x = np.append(rows[i][0], SLOTS), np.append(rows[i][1], 1.0)
            w = solve(at)
            p = _softmax((x @ w)[None])[0]
            p[target[i]] -= 1.0
            g = x[:, None] * p
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / alpha * w
            n[at] = squared
    w = solve(np.arange(SLOTS + 1))
    model = Model(names, np.vstack([w[:SLOTS] * idf[:, None], np.zeros(k)]).astype(np.float32), w[SLOTS].copy())
    held = [i for i in range(len(rows)) if i % apart == 0]
    logits = np.array([rows[i][1] @ w[rows[i][0]] + w[SLOTS] for i in held]).reshape(len(held), k)

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), target[held]], 1e-12)).mean()

    if held:
        low, high = np.log(0.05), np.log(20.0)
        for _ in range(40):  # golden section: the loss has one minimum in log t
            a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
            low, high = (low, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 5, is 0 (null: empty)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from labelled documents that are not held out."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(doc_id, text).alias("h"))
    is_short = F.length("text") <= MAX_SAMPLE_CHARS
    counts = {r["label"]: (r["short"], r["all"]) for r in usable.groupBy("label").agg(F.count_if(is_short).alias("short"), F.count("*").alias("all")).collect()}
    if not counts:
        return Model([], np.zeros((SLOTS + 1, 0)), np.zeros(0))
    frequencies, n = document_frequencies(usable)
    each = MAX_SAMPLE / len(counts)
    picked = F.lit(False)
    for name, (short, count) in sorted(counts.items()):
        # The beginnings of long texts stand in where short ones are too few.
        enough = short >= MIN_SHORT
        share = min(1.0, each / (short if enough else count))
        picked = picked | ((F.col("label") == name) & (is_short if enough else F.lit(True)) & in_share(F.col("h"), share))
    sample = usable.where(picked).withColumn("text", F.substring("text", 1, MAX_SAMPLE_CHARS)).toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    return train(sample["text"].to_pylist(), sample["label"].to_pylist(), frequencies, n)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, and lang_pred and score (0 to 1, calibrated)."""
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for a, b in chunks(batch.column(n_kept), 1 << 20):
                names, scores = found.predict(batch.column(n_kept).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n_kept)), pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return docs.select(*(f.name for f in kept), docs[text].alias("__text")).mapInArrow(run, schema)
