"""Benchmark decontamination: a prefix-filtered containment join of item windows.

A window is ``window`` consecutive words of an item (a shorter item is one window).
Its tokens are word shingles (three words, or the whole window if shorter).  A
document contains a window only if it contains every token, so at a containment of
one the prefix of a window in rare-first order is its one rarest token; rarity is
the document frequency over all documents.  Documents are probed for prefix tokens
only; candidates must fit the document's length and the token's position in the
window, then all words' hashes must agree, then the bytes.

Benchmark items are broadcast in blocks of at most ``BLOCK_BYTES`` of text; each block
is one more map over the documents, so any number of items works.  There is no shuffle
of documents.

Defined results: null or wordless texts have no words and no hits; items without words
have no windows; an item id of null is written as the empty string; rows are
independent, so ties and repeated rows get equal results; texts over one pass are handled
whole; an empty table of documents or of items gives no hits; other columns are kept as they
are, and an input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import byte_values, chunks, gram_hashes, text_bytes, word_hashes, word_spans

BLOCK_BYTES = 16 << 20
SHINGLE = 3
_VALUES = byte_values(8, fold_case=True)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


#: A character of a word, as Java's expressions have it.
_WORD_TEXT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


@dataclass
class Words:
    """The words of several texts in one byte array."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end

    def raw(self, a: int, b: int) -> bytes:
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes()


def words_of(column: pa.Array) -> Words:
    data, offsets = text_bytes(column, b"\n")
    starts, ends = word_spans(data, _WORD)
    hashes = word_hashes(data, _VALUES, starts, ends)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def normal(raw: bytes) -> bytes:
    """Lower-cased words with one space between."""
    data = np.frombuffer(raw, np.uint8)
    return b" ".join(np.where(_WORD[data], data, 32).astype(np.uint8).tobytes().lower().split())


class Probe:
    """Membership of many hashes in a small sorted set: a bit table, then a search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold a key, and which key."""
        if len(self.keys) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


class Block:
    """Windows of some benchmark items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        words = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        item, start, size = [], [], []
        for i in range(len(ids)):
            a, b = int(words.first[i]), int(words.first[i + 1])
            for s in range(a, max(b - window, a) + 1) if b > a else ():
                item.append(i)
                start.append(s)
                size.append(min(window, b - a))
        self.item, self.size = np.array(item, np.int64), np.array(size, np.int64)
        start = np.array(start, np.int64)
        self.ends = np.cumsum(self.size)
        at = np.arange(int(self.size.sum())) + np.repeat(start - (self.ends - self.size), self.size)
        self.hashes = words.hashes[at]
        self.normal = [normal(words.raw(s, s + n)) for s, n in zip(start.tolist(), size, strict=True)]
        #: All tokens of all windows: window, offset, hash, by token length.
        self.tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(1, SHINGLE + 1):
            mine = np.flatnonzero(self.size >= SHINGLE if k == SHINGLE else self.size == k)
            if len(mine):
                counts = self.size[mine] - k + 1
                ends = np.cumsum(counts)
                offset = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
                where = np.repeat((self.ends - self.size)[mine], counts) + offset
                grams = np.zeros(len(self.hashes), np.uint64)
                found = gram_hashes(self.hashes, k)
                grams[: len(found)] = found
                self.tokens[k] = np.repeat(mine, counts), offset, grams[where]
        self.vocabulary = {k: np.unique(t[2]) for k, t in self.tokens.items()}

    def choose(self, frequency: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest token (ties: smallest hash) as its prefix."""
        self.prefix: dict[int, tuple[Probe, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, (window, offset, grams) in self.tokens.items():
            count = frequency[k][np.searchsorted(self.vocabulary[k], grams)]
            by = np.lexsort((offset, grams, count, window))
            head = by[np.concatenate([[True], window[by][1:] != window[by][:-1]])]
            head = head[np.argsort(grams[head], kind="stable")]
            keys, first = np.unique(grams[head], return_index=True)
            self.prefix[k] = Probe(keys), np.append(first, len(head)), window[head], offset[head]
        self.tokens = {}

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of the places where all word hashes agree."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(words.hashes)
        text_end = np.repeat(words.first[1:], np.diff(words.first))
        text_start = np.repeat(words.first[:-1], np.diff(words.first))
        for k, (probe, first, window, offset) in self.prefix.items():
            at, key = probe.find(gram_hashes(words.hashes, k))
            counts = first[key + 1] - first[key]
            ends = np.cumsum(counts)
            row = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[key] - (ends - counts), counts)
            place, w = np.repeat(at, counts), window[row]
            start = place - offset[row]
            fits = (start >= text_start[place]) & (start + self.size[w] <= text_end[place]) if n else np.zeros(0, bool)
            start, w = start[fits], w[fits]
            if len(w):
                sizes = self.size[w]
                ends = np.cumsum(sizes)
                inner = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
                same = words.hashes[np.repeat(start, sizes) + inner] == self.hashes[np.repeat((self.ends - self.size)[w], sizes) + inner]
                good = np.logical_and.reduceat(same, ends - sizes)
                starts.append(start[good])
                windows.append(w[good])
        return np.concatenate(starts), np.concatenate(windows)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose bytes agree."""
        starts, windows = self.candidates(words)
        known: dict[tuple[int, bytes], bool] = {}
        good = np.zeros(len(starts), bool)
        for i, (s, w) in enumerate(zip(starts.tolist(), windows.tolist(), strict=True)):
            key = w, words.raw(s, s + int(self.size[w]))
            if key not in known:
                known[key] = normal(key[1]) == self.normal[w]
            good[i] = known[key]
        return starts[good], windows[good]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(item_id, text).toLocalIterator():
        ids.append("" if i is None else str(i))
        texts.append(t)
        size += len((t or "").encode())
        if size >= BLOCK_BYTES:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
    yield Block(ids, texts, window)


def _frequencies(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each token of the block occurs."""
    probes = {k: Probe(v) for k, v in block.vocabulary.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(len(p.keys), np.int64) for k, p in probes.items()}
        for batch in batches:
            column = batch.column(0)
            for a, b in chunks(column):
                words = words_of(column.slice(a, b - a))
                for k, probe in probes.items():
                    at, key = probe.find(gram_hashes(words.hashes, k))
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + k <= words.first[doc + 1]
                    pairs = np.unique(doc[inside] * len(probe.keys) + key[inside])
                    counts[k] += np.bincount(pairs % len(probe.keys), minlength=len(probe.keys))
        for k, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(some), k), pa.int32()), "token": some, "n": c[some]})

    out = {k: np.zeros(len(v), np.int64) for k, v in block.vocabulary.items()}
    rows = docs.select(text).mapInArrow(run, "k int, token long, n long").groupBy("k", "token").sum("n")
    for k, token, n in rows.collect():  # at most the block's tokens
        out[k][token] = n
    return out


_HIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", _HIT)]


def _scan(docs: DataFrame, text: str, block: Block, again: bool) -> DataFrame:
    """Adds the block's hits; ``again``: to those that the rows have already."""
    names = [f.name for f in _ADDED]
    kept = [f for f in docs.schema if f.name not in names]
    schema = T.StructType(kept + _ADDED)
    hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(n_kept)
            for a, b in chunks(column):
                n = b - a
                words = words_of(column.slice(a, n))
                first = words.first
                start, window = block.hits(words)
                doc = np.searchsorted(first, start, side="right") - 1
                end = start + block.size[window]
                items: list[set[str]] = [set() for _ in range(n)]
                for d, i in np.unique(np.stack([doc, block.item[window]]), axis=1).T.tolist():
                    items[d].add(block.ids[i])
                if again:
                    for d, (old, spans) in enumerate(zip(batch.column(n_kept + 1).slice(a, n).to_pylist(), batch.column(n_kept + 2).slice(a, n).to_pylist(), strict=True)):
                        items[d].update(old)
                        start = np.append(start, np.array([s["start"] for s in spans], np.int64) + first[d])
                        end = np.append(end, np.array([s["end"] for s in spans], np.int64) + first[d])
                step = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, end, -1)
                covered = np.cumsum(step)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(covered)])
                n_hit = total[first[1:]] - total[first[:-1]]
                edge = covered.copy()
                heads = first[:-1][first[:-1] < len(covered)]
                edge[1:] &= ~covered[:-1]
                edge[heads] = covered[heads]
                at = np.flatnonzero(edge)
                of = np.searchsorted(first, at, side="right") - 1
                stops = np.append(np.flatnonzero(~covered), len(covered))
                to = np.minimum(stops[np.searchsorted(stops, at)], first[of + 1])
                spans = pa.StructArray.from_arrays([pa.array(at - first[of]), pa.array(to - first[of])], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), spans).cast(hit_type)
                added = [pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, n) for i in range(n_kept)), *added], schema.names)

    extra = [docs["items"].alias("__items"), docs["hits"].alias("__hits")] if again else []
    return docs.select(*(f.name for f in kept), docs[text].alias("__text"), *extra).mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, items (sorted ids), hits (word spans)."""
    out, again = docs, False
    for block in _blocks(benchmark, item_id, item_text, window):
        block.choose(_frequencies(docs, text, block))
        out, again = _scan(out, text, block, again), True
    return out


def cut_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``find_contamination`` with ``text`` less its hits and what stands between their words; expressions only, as a second Python worker a task takes memory."""
    # Words and what stands between them in turn; word j is piece 2 j, or one later.
    # Only of texts with hits: a null costs nothing, wherever the expression is evaluated.
    hit = F.when(F.col("n_hit") > 0, F.col(text))
    pieces = F.regexp_extract_all(hit, F.lit(f"{_WORD_TEXT}+|[^{_WORD_TEXT[1:]}+"), F.lit(0))
    shift = F.when(hit.rlike(f"^{_WORD_TEXT}"), 0).otherwise(1)
    cut = lambda i: F.exists("hits", lambda h: (i >= 2 * h["start"] + shift) & (i <= 2 * h["end"] - 2 + shift))
    left = F.array_join(F.filter(pieces, lambda x, i: ~cut(i)), "")
    less = F.when(F.col("n_hit") > 0, left).otherwise(F.col(text))
    return found.select(*(less.alias(c) if c == text else F.col(c) for c in found.columns))
