"""Repeated byte strings, through enhanced suffix arrays of content-defined regions.

Every ``min_len``-byte string holds an anchor: the least-hash 32-byte gram among those
inside it (leftmost on ties), so equal strings have equal anchors at equal offsets.  The
strings that choose the same anchor form one region of the text.  Only regions whose
anchor occurs again matter:

* An anchor whose regions are all equal needs no comparison: all are covered.
* Otherwise the distinct regions of an anchor meet in one task, which builds the suffix
  array of their bytes (prefix doubling), takes the LCP-interval tree with a stack scan,
  and keeps intervals of depth ``min_len`` or more whose occurrences differ in the
  character to their left: the maximal repeats, each with all its occurrences.

The bytes to remove are the union of those occurrences.  Equal texts form one class;
the copies' strings all repeat, and one copy stands for them in every comparison.
An anchor with more than ``MANY_REGIONS`` distinct regions is split by the strings' offset
to the anchor, in steps of ``STEP``, and by the hash of what all strings of a step share:
equal strings stay together, and no task gets all regions of a hot anchor.

Repeats longer than a region are cut by it; ``repeat_groups`` puts fragments together whose
occurrences all follow each other, so a long repeat is one group with all its occurrences.
A part of it that occurs more often is a group of its own, as in any suffix tree, but is
listed region by region where its occurrences change within it.

Defined results: null and empty texts have no strings; texts shorter than ``min_len``
lose nothing; repeated rows are occurrences of each other; columns other than the id
and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _tables
from folioscope.llm._common import byte_values, chunks, materialize, mix, prefix_hashes, prime_hashes, range_hashes, text_bytes

GRAM = 32
#: Text bytes whose regions are found at a time, about 200 bytes of memory each.
REGION_BYTES = 1 << 18
#: Region bytes of one suffix array, about 100 bytes of memory each; a task builds one after another.
ARRAY_BYTES = 1 << 18
MANY_REGIONS = 2000
STEP = 16
_VALUES = byte_values(1)
_LOW = np.uint64(0xFFFFFFFF)


def regions(data: np.ndarray, offsets: np.ndarray, min_len: int) -> dict[str, np.ndarray]:
    """Regions of several texts: anchor hash, region hash, text, start in it, length."""
    width = min_len - GRAM + 1
    n = len(data) - GRAM + 1
    sizes = np.diff(offsets)
    first = offsets[:-1][sizes >= min_len]
    empty = {k: np.zeros(0, np.int64) for k in ("h", "c", "text", "start", "size", "cover", "at")}
    if len(first) == 0:
        return empty
    prefix = prefix_hashes(data, _VALUES)
    at = np.arange(n)
    grams = range_hashes(prefix, at, at + GRAM)
    # The upper half decides, then the position; a window of `width` grams lies in one text.
    key = (grams & ~_LOW) | at.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    counts = sizes[sizes >= min_len] - min_len + 1
    ends = np.cumsum(counts)
    window = np.arange(int(ends[-1])) + np.repeat(first - (ends - counts), counts)
    anchor = (np.minimum(backward[window], forward[window + width - 1]) & _LOW).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    heads = np.flatnonzero(new)
    start = window[heads]
    stop = window[np.append(heads[1:], len(window)) - 1] + min_len
    h = grams[anchor[heads]].view(np.int64)
    # Equal regions are not compared byte by byte, so a second hash of another kind is mixed in.
    c = mix(range_hashes(prefix, start, stop) + prime_hashes(data, _VALUES, start, stop) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    text = np.searchsorted(offsets, start, side="right") - 1
    # A run of equal regions one byte apart (one repeated character): its two ends tell all.
    like = np.zeros(len(h), bool)
    like[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (start[1:] == start[:-1] + 1) & (text[1:] == text[:-1])
    last = np.append(~like[1:], True)
    run_end = np.flatnonzero(last)[np.cumsum(np.append(0, last[:-1]))]
    cover = stop[run_end] - start
    keep = ~like | last
    return {k: v[keep] for k, v in {"h": h, "c": c, "text": text, "start": start - offsets[text], "size": stop - start, "cover": cover, "at": anchor[heads] - start}.items()}


class SuffixArray:
    """Sorted suffixes of several byte strings; a suffix ends with its string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(data)
        self.data, self.offsets = data, offsets
        # Four bytes a number: an array is far below 2 GB.
        self.owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
        self.left = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets)) - np.arange(n, dtype=np.int32)  # bytes to the string's end
        words = np.minimum(self.left, 7).astype(np.uint64)
        for j in range(7):  # seven bytes, then how many of them are there
            words[: max(n - j, 0)] |= np.where(self.left[: max(n - j, 0)] > j, data[j:], np.uint8(0)).astype(np.uint64) << np.uint64(56 - 8 * j)
        self.order = np.argsort(words, kind="stable").astype(np.int32)
        words = words[self.order]
        rank = self._ranks(np.concatenate([[True], words[1:] != words[:-1]]) if n else np.zeros(0, bool), self.order)
        del words
        depth = 7
        places = np.arange(n, dtype=np.int32)  # what is told apart once stays so
        while True:
            sorted_rank = rank[self.order[places]]
            twin = np.zeros(len(places), bool)
            twin[1:] = sorted_rank[1:] == sorted_rank[:-1]
            twin[:-1] |= twin[1:]
            places = places[twin]
            suffix = self.order[places]
            if len(suffix) == 0 or (self.left[suffix] <= depth).all():
                break
            further = np.where(self.left[suffix] > depth, rank[np.minimum(suffix + depth, n - 1)] + 1, 0)
            key = rank[suffix].astype(np.uint64) << np.uint64(32) | further.astype(np.uint64)
            by = np.argsort(key, kind="stable")
            suffix, key = suffix[by], key[by]
            self.order[places] = suffix
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            rank[suffix] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
            depth *= 2
        self.prefix = prefix_hashes(data, _VALUES)

    @staticmethod
    def _ranks(fresh: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) if len(order) else order
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray, low: int) -> np.ndarray:
        """Lengths of the common prefixes of suffix pairs, known to be ``low`` at least."""
        lo = np.full(len(a), low)
        hi = np.minimum(self.left[a], self.left[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = range_hashes(self.prefix, a, a + mid) == range_hashes(self.prefix, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def repeats(self, min_len: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, all starts) of every maximal repeat of at least ``min_len`` bytes."""
        suffix = self.order[self.left[self.order] >= min_len]
        if len(suffix) < 2:
            return
        head = range_hashes(self.prefix, suffix, suffix + min_len)
        joined = head[1:] == head[:-1]
        before = np.where(suffix == self.offsets[self.owner[suffix]], -1 - self.owner[suffix], self.data[suffix - 1].astype(np.int64))
        differs = np.concatenate([[0], before[1:] != before[:-1]])
        cluster = np.concatenate([[0], np.cumsum(~joined)])
        diverse = np.bincount(cluster[1:], weights=joined & (differs[1:] > 0), minlength=cluster[-1] + 1) > 0
        keep = diverse[cluster]
        suffix, cluster = suffix[keep], cluster[keep]
        if len(suffix) < 2:
            return
        changes = np.cumsum(differs[keep])
        lcp = np.zeros(len(suffix), np.int64)
        inside = np.flatnonzero(cluster[1:] == cluster[:-1])
        lcp[inside + 1] = self._common(suffix[inside], suffix[inside + 1], min_len)
        # Stack scan: an interval closes when a smaller value comes.
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*lcp[1:].tolist(), 0], 1):
            begin = i - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if changes[i - 1] > changes[begin]:  # some neighbour differs on the left
                    yield length, suffix[begin:i]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def _cover(texts: list[bytes], many: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each region, the bytes that maximal repeats cover: one range around the anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    array = SuffixArray(np.frombuffer(b"".join(texts), np.uint8), offsets)
    low, high = np.where(many, 0, sizes), np.where(many, sizes, 0)
    for length, starts in array.repeats(min_len):
        owner = array.owner[starts]
        at = starts - offsets[owner]
        np.minimum.at(low, owner, at)
        np.maximum.at(high, owner, at + length)
    return low, high


_REGION = "h long, c long, t long, start long, size long, cover long, at long"


def pieces(raw: bytes, at: int, min_len: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, offset, bytes) of a region's strings, ``STEP`` offsets to the anchor at a time."""
    last = len(raw) - min_len  # where the last string starts
    for step in range(at // STEP + 1):
        low, high = max(0, at - STEP * step - STEP + 1), min(last, at - STEP * step)
        if low <= high:
            # Shared by all strings of this step, whether or not this region has them all.
            core = raw[at - STEP * step : at - STEP * step - STEP + 1 + min_len]
            digest = hashlib.blake2b(core, digest_size=8, salt=step.to_bytes(8, "little")).digest()
            yield int.from_bytes(digest, "little", signed=True), low, raw[low : high + min_len]


def region_batches(batches: Iterator[pa.RecordBatch], min_len: int) -> Iterator[pa.RecordBatch]:
    """Regions of the rows (t, text), a bounded number of bytes at a time; a text class is read once."""
    seen: set[int] = set()
    for batch in batches:
        for a, b in chunks(batch.column(1), REGION_BYTES):
            keys = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
            fresh = np.array([k not in seen and not seen.add(k) for k in keys.tolist()])
            data, offsets = text_bytes(batch.column(1).slice(a, b - a).filter(pa.array(fresh)))
            found = regions(data, offsets, min_len)
            yield pa.RecordBatch.from_arrays([found["h"], found["c"], keys[fresh][found["text"]], found["start"], found["size"], found["cover"], found["at"]], ["h", "c", "t", "start", "size", "cover", "at"])


def _all_regions(docs: DataFrame, min_len: int) -> DataFrame:
    return docs.select("t", "text").mapInArrow(lambda batches: region_batches(batches, min_len), _REGION)


def _cut(docs: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """(key, h, c, off, many, data): the wanted regions by anchor, or their pieces.

    A text class is read once a task.  ``wanted`` is a written table.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_tables.SLOTS, np.int64)
        for batch in batches:
            counts[_tables.slot_of(batch.column(0).to_numpy().view(np.uint64))] = 1
        parts, data = _tables.parts_of(counts)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    table = docs.sparkSession.sparkContext.broadcast(_tables.sum_parts(wanted.select("t").mapInArrow(mark, "part int, data binary")) > 0)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = table.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            good = marked[_tables.slot_of(keys.view(np.uint64))]
            good = np.array([g and k not in seen and not seen.add(k) for k, g in zip(keys.tolist(), good.tolist(), strict=True)], bool)
            yield batch.filter(pa.array(good))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows: list[tuple] = []
            for t, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if t == last:
                    continue  # the same class from another task
                last, raw = t, text.as_py().encode()
                for x in items.as_py():
                    region = raw[x["start"] : x["start"] + x["size"]]
                    parts = pieces(region, x["at"], min_len) if x["split"] else ((x["h"], 0, region),)
                    rows += [(key, x["h"], x["c"], off, x["many"], part) for key, off, part in parts]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["key", "h", "c", "off", "many", "data"])

    large = wanted.groupBy("h").count().where(F.col("count") > MANY_REGIONS).select("h", F.lit(True).alias("split"))
    wanted = wanted.join(large, "h", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    lists = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "c", "many", "split", "start", "size", "at")).alias("items"))
    found = docs.select("t", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(texts, "t long, text string")
    return found.join(lists, "t").sortWithinPartitions("t").mapInArrow(cut, "key long, h long, c long, off long, many boolean, data binary")


@dataclass
class Strings:
    """The strings of one suffix array, and the places (rows of ``_cut``) that share each of them."""

    data: list[bytes]
    many: np.ndarray  # of each string: it occurs more than once as it is
    of: np.ndarray  # of each place: its string
    h: np.ndarray
    c: np.ndarray
    off: np.ndarray

    @classmethod
    def of_rows(cls, data: list[bytes], many: list[bool], places: list[tuple[int, int, int, int]]) -> Strings:
        of, h, c, off = np.array(places, np.int64).reshape(-1, 4).T
        return cls(data, np.array(many, bool), of, h, c, off)

    def places_of(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each of the strings, and at which of ``strings`` each place's string stands."""
        by = np.argsort(self.of, kind="stable")
        first = np.searchsorted(self.of[by], np.arange(len(self.data) + 1))
        counts = np.diff(first)[strings]
        at = np.repeat(np.arange(len(strings)), counts)
        return by[np.arange(len(at)) + np.repeat(first[strings] - (np.cumsum(counts) - counts), counts)], at


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[Strings]:
    """Rows of ``_cut`` for one suffix array after another; a key's rows stay together.

    Pieces of a hot anchor are mostly equal: equal bytes of a key are one string.
    """
    data: list[bytes] = []
    many: list[bool] = []
    places: list[tuple[int, int, int, int]] = []
    found: dict[bytes, int] = {}
    size, last = 0, None
    for batch in batches:
        for key, h, c, off, more, raw in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if last == (key, h, c, off):
                continue  # a region that two tasks cut
            if last is None or key != last[0]:
                if size >= ARRAY_BYTES:
                    yield Strings.of_rows(data, many, places)
                    data, many, places, size = [], [], [], 0
                found = {}
            last = (key, h, c, off)
            at = found.setdefault(raw, len(data))
            if at == len(data):
                data.append(raw)
                many.append(more)
                size += len(raw)
            else:
                many[at] = True
            places.append((at, h, c, off))
    if places:
        yield Strings.of_rows(data, many, places)


def _by_key(cuts: DataFrame) -> DataFrame:
    return cuts.repartition("key").sortWithinPartitions("key", "h", "c", "off")


def _covered(cuts: DataFrame, min_len: int) -> DataFrame:
    """(h, c, low, high) of the distinct regions, suffix array by suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _arrays(batches):
            low, high = (x[held.of] for x in _cover(held.data, held.many, min_len))
            some = high > low
            shift = held.off[some]
            yield pa.RecordBatch.from_arrays([pa.array(held.h[some]), pa.array(held.c[some]), pa.array(low[some] + shift), pa.array(high[some] + shift)], ["h", "c", "low", "high"])

    found = _by_key(cuts).mapInArrow(run, "h long, c long, low long, high long")
    return found.groupBy("h", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _compared(docs: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of repeated anchors, the bytes to compare, and whole copies (t, n, e)."""
    found = materialize(_all_regions(docs, min_len), "regions").withColumn("o", F.xxhash64("t", "start"))
    anchors = found.groupBy("h").agg(F.min("o").alias("o1"), F.max("o").alias("o2"), (F.min("c") != F.max("c")).alias("mixed")).where("o1 <> o2").select("h", "mixed")
    # Written first: a join of two plain shuffles can split an anchor that many regions share.
    found = materialize(found.join(materialize(anchors, "anchors"), "h"), "repeated")
    wanted = found.where("mixed").groupBy("h", "c").agg(F.min(F.struct("t", "start", "size", "at")).alias("one"), (F.min("o") != F.max("o")).alias("many")).select("h", "c", "many", "one.*")
    wanted = materialize(wanted, "wanted")
    copies = docs.groupBy("t").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).cast("long").alias("e")).where(F.expr(f"n > 1 and e >= {int(min_len)}"))
    return found, _cut(docs, wanted, min_len), copies


def repeated_spans(docs: DataFrame, min_len: int) -> DataFrame:
    """(t, spans) of the text classes with covered bytes; ``docs`` has t, the text's hash, and text."""
    found, cuts, copies = _compared(docs, min_len)
    covered = materialize(_covered(cuts, min_len), "covered")  # written first, as the anchors
    within = found.where("mixed").join(covered, ["h", "c"]).select("t", (F.col("start") + F.col("low")).alias("s"), F.greatest(F.col("start") + F.col("high"), F.when((F.col("low") == 0) & (F.col("high") == F.col("size")), F.col("start") + F.col("cover")).otherwise(0)).alias("e"))
    whole = found.where("not mixed").select("t", F.col("start").alias("s"), (F.col("start") + F.col("cover")).alias("e"))
    return whole.unionByName(within).unionByName(copies.select("t", F.lit(0).cast("long").alias("s"), "e")).distinct().groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def repeat_groups(docs: DataFrame, min_len: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(group_id, length, doc_id, start): the maximal repeats with all their occurrences.

    A row per occurrence; equal strings have equal group ids.  Inside a run of one repeated
    character only the ends' strings are listed.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    found, cuts, copies = _compared(base, min_len)
    names = ["group_id", "length", "h", "c", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _arrays(batches):
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in held.data])])
            array = SuffixArray(np.frombuffer(b"".join(held.data), np.uint8), offsets)
            whole = [(int(offsets[i + 1] - offsets[i]), offsets[i : i + 1]) for i in np.flatnonzero(held.many)]
            for length, starts in (*array.repeats(min_len), *whole):
                owner = array.owner[starts]
                group = range_hashes(array.prefix, starts[:1], starts[:1] + length).view(np.int64)
                places, at = held.places_of(owner)
                yield pa.RecordBatch.from_arrays([np.repeat(group, len(places)), np.full(len(places), length), held.h[places], held.c[places], (starts - offsets[owner])[at] + held.off[places]], names)

    groups = _by_key(cuts).mapInArrow(run, "group_id long, length long, h long, c long, place long").distinct()
    within = found.where("mixed").join(groups, ["h", "c"]).select("group_id", "length", "t", (F.col("start") + F.col("place")).alias("start"))
    whole = found.where("not mixed").select(F.col("c").alias("group_id"), F.col("size").alias("length"), "t", "start")
    same = copies.select(F.col("t").alias("group_id"), F.col("e").alias("length"), "t", F.lit(0).cast("long").alias("start"))
    parts = materialize(within.unionByName(whole).distinct(), "fragments")
    made = _joined_fragments(parts, min_len).unionByName(same).distinct()
    # Groups are of text classes; a copy has what its class has.
    return made.join(base.select("doc_id", "t"), "t").select("group_id", "length", "doc_id", "start")


def _joined_fragments(parts: DataFrame, min_len: int) -> DataFrame:
    """(group_id, length, t, start): fragments that regions or splits cut out of one repeat, put together again.

    A fragment is continued by one whose first string follows its last, where all
    occurrences of both do so; such fragments form chains, and a chain is one repeat.
    """
    parts = parts.withColumn("g", F.xxhash64("group_id", "length"))
    groups = materialize(parts.groupBy("g").agg(F.first("length").alias("length"), F.count("*").alias("n"), F.min(F.struct("t", "start")).alias("least")), "fragment-groups")
    ends = parts.select("t", (F.col("start") + F.col("length") - (min_len - 1)).alias("start"), F.col("g").alias("u"))
    pairs = ends.join(parts.select("t", "start", F.col("g").alias("v")), ["t", "start"]).groupBy("u", "v").agg(F.count("*").alias("c"))
    size = lambda x, n: groups.select(F.col("g").alias(x), F.col("n").alias(n))
    links = pairs.join(size("u", "m"), "u").join(size("v", "n"), "v").where("c = m and c = n and u <> v")
    chains = _tables.connected_components(links)
    groups = groups.join(chains, groups["g"] == chains["node"], "left").select("g", F.coalesce("component", "g").alias("chain"), "length", "least")
    # Occurrences of a chain's fragments are shifted alike, so the least ones belong together.
    whole = groups.groupBy("chain").agg(F.min("least").alias("first"), F.max(F.col("least.start") + F.col("length")).alias("end"))
    heads = groups.join(materialize(whole, "chains"), "chain").where("least = first").groupBy("chain").agg(F.min("g").alias("g"), (F.first("end") - F.first("first.start")).alias("whole"))
    found = parts.join(materialize(heads, "chain-heads"), "g")
    return found.select(F.col("chain").alias("group_id"), F.col("whole").alias("length"), "t", "start")


def remove_repeats(docs: DataFrame, min_len: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), removed (maximal byte spans)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    spans = materialize(repeated_spans(base, min_len), "spans")  # written first, see ``anchors``
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_type = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sizes, kept, removed = [], [], []
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    raw = text.as_py().encode()
                    merged: list[list[int]] = []
                    for s in sorted((x["s"], x["e"]) for x in spans.as_py() or ()):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    cuts = [0, *(x for s in merged for x in s), len(raw)]
                    sizes.append(len(raw))
                    kept.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)) if merged else raw)
                    removed.append([{"start": s, "end": e} for s, e in merged])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], ["doc_id", "n_bytes", "kept", "removed"])

    return base.join(spans, "t", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {id_type}, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")
