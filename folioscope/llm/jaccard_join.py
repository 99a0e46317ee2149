"""Self-join of documents by the Jaccard similarity of their word shingle sets.

1. One pass hashes every document's distinct shingles.  Equal sets form one class
   (64-bit hash of the set), which takes part once; the pass also counts, for every
   shingle, in how many documents its slot of a fixed table occurs.
2. Shingles are ordered rare first (slot count, then hash).  Two sets over the threshold
   share a shingle among each one's first n - ceil(t n) + 1, so only those are joined.
   Each carries its position and 16 bucket counts of the whole set.
3. In each shingle's group, pairs must pass the length filter, the positional filter and
   the suffix filter (bucket counts bound the symmetric difference from below).
4. Each remaining pair that a sketch of 256 bucket counts does not rule out is verified
   once on the whole sets.

Groups of up to ``SMALL_GROUP`` classes give all their pairs at once.  So that a larger
group of n near copies does not become n^2 pairs, its members are first compared with two
leaders of the group only.  The next rounds compare each member with the one that a
sketch of 256 bucket counts puts nearest among those of other components (its distance
bounds the symmetric difference from below).  The last round compares all that are still
in different components and pass every filter.  No pair over the threshold is lost: it is
verified, or its ends are connected already.

Defined results: null and wordless texts have an empty set and are linked with nothing;
a text of fewer words than a shingle is one shingle; ties and repeated rows belong to one
class; rows that share a document id count as linked; rows with a null id have a null
component and link nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _tables
from folioscope.llm._common import byte_values, chunks, gram_hashes, materialize, mix, text_bytes, word_hashes, word_spans

_VALUES = byte_values(9, fold_case=True)
_WORD = np.ones(256, bool)
_WORD[9:14] = _WORD[32] = False
_EMPTY = np.zeros(0, np.uint64)
_BUCKETS = 256
SMALL_GROUP = 16
#: Rounds of nearest partners before the last, complete one.
NEAREST_ROUNDS = 3


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column, b"\n")
    starts, ends = word_spans(data, _WORD)
    words = word_hashes(data, _VALUES, starts, ends)
    grams = gram_hashes(words, k)
    first = np.searchsorted(starts, offsets).tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            found = np.sort(grams[a : b - k + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        else:
            yield gram_hashes(words[a:b], b - a) if b > a else _EMPTY


def _class_id(found: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(found).sum() ^ (mix(~found).sum() << np.uint64(1)) ^ np.uint64(len(found))], np.uint64)).view(np.int64)[0]


def _signatures(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, n, cid, data) of the documents, data the sketch, once a task; and
    rows (part, data) of the count table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_tables.SLOTS, np.int64)
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                n, cid = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                slots, marks = [], [None] * (b - a)
                for i, found in enumerate(shingle_sets(batch.column(1).slice(a, b - a), k)):
                    n[i] = len(found)
                    if len(found):
                        cid[i] = _class_id(found)
                        slots.append(_tables.slot_of(found))
                        if int(cid[i]) not in seen:
                            seen.add(int(cid[i]))
                            marks[i] = (np.bincount((found & np.uint64(_BUCKETS - 1)).astype(np.int64), minlength=_BUCKETS) & 255).astype(np.uint8).tobytes()
                if slots:
                    np.add.at(counts, np.concatenate(slots), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(cid), pa.nulls(b - a, pa.int32()), pa.array(marks, pa.binary())], names)
        parts, data = _tables.parts_of(counts)
        some = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(some, pa.int64()), pa.nulls(some, pa.int64()), pa.nulls(some, pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names)

    names = ["doc_id", "n", "cid", "part", "data"]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, cid long, part int, data binary")


def _prefixes(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray, text: str) -> DataFrame:
    """Rows (token, cid, n, pos, s1, s2): the rare-first prefix of each class, once a task."""
    table = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["token", "cid", "n", "pos", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = table.value
        seen: set[int] = set()
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                tokens, heads, sizes, marks = [_EMPTY], [], [], []
                for found in shingle_sets(batch.column(0).slice(a, b - a), k):
                    n = len(found)
                    if n == 0 or (cid := int(_class_id(found))) in seen:
                        continue
                    seen.add(cid)
                    keep = n + (-num * n // den) + 1
                    count = frequency[_tables.slot_of(found)]
                    # Whole shingles up to the keep-th count, then ordered by count and hash.
                    at = np.flatnonzero(count <= np.partition(count, keep - 1)[keep - 1]) if keep < n else np.arange(n)
                    at = at[np.lexsort((found[at], count[at]))][:keep]
                    tokens.append(found[at])
                    heads.append((cid, n))
                    sizes.append(keep)
                    marks.append((np.bincount((found & np.uint64(15)).astype(np.int64), minlength=16) & 255).astype(np.uint8).view(np.int64))
                if heads:
                    sizes_, heads_, marks_ = np.array(sizes), np.array(heads, np.int64), np.array(marks)
                    ends = np.cumsum(sizes_)
                    row = np.repeat(np.arange(len(sizes_)), sizes_)
                    pos = np.arange(int(ends[-1])) - (ends - sizes_)[row]
                    yield pa.RecordBatch.from_arrays([np.concatenate(tokens).view(np.int64), heads_[row, 0], heads_[row, 1], pa.array(pos, pa.int32()), marks_[row, 0], marks_[row, 1]], names)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, cid long, n long, pos int, s1 long, s2 long")


def _sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts are kept modulo 256: the way round the circle is at most the difference."""
    return np.abs((a - b).view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)


class _Group:
    """Index rows sorted by token; pairs of rows that may be over the threshold."""

    def __init__(self, columns: list[np.ndarray], num: int, den: int) -> None:
        self.token, self.cid, self.n, self.pos, s1, s2 = columns[:6]
        self.num, self.den = num, den
        self.marks = np.stack([s1, s2], axis=1).view(np.uint8).reshape(-1, 16)
        self.sketch = columns[7] if len(columns) > 7 else None

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.n[i], self.n[j]
        least = np.minimum(a, b)
        need = -(-self.num * (a + b) // (self.num + self.den))
        good = self.den * least >= self.num * np.maximum(a, b)
        good &= np.minimum(a - self.pos[i], b - self.pos[j]) >= need
        at = np.flatnonzero(good)
        # Bucket counts modulo 256: the way round the circle is at most the difference.
        apart = (self.marks[i[at]] - self.marks[j[at]]).view(np.int8).astype(np.int16)
        good[at] = np.abs(apart).sum(axis=1) <= (a + b - 2 * need)[at]
        if self.sketch is not None:
            at = np.flatnonzero(good)
            good[at] = self.apart(i[at], j[at]) <= (a + b - 2 * need)[at]
        return good

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least symmetric differences that the sketches allow."""
        return _sketch_distance(self.sketch[i], self.sketch[j])

    def nearest(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, each first member's nearest partner and each second member's."""
        if len(i) == 0:
            return i, j
        far = self.apart(i, j)
        keep = np.zeros(len(i), bool)
        for side in (i, j):
            by = np.lexsort((far, side))
            keep[by[np.concatenate([[True], side[by][1:] != side[by][:-1]])]] = True
        return i[keep], j[keep]


def _values(column: pa.Array) -> np.ndarray:
    """Numbers, or the rows of a sketch column."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), _BUCKETS)
    return column.to_numpy(zero_copy_only=False)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of many rows that hold whole token groups of at least two classes."""
    held: list[list[np.ndarray]] = []
    size = 0

    def ready(last: bool) -> list[np.ndarray] | None:
        nonlocal held, size
        if not held:
            return None
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held, size = [], 0
        if not last:
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[cut:] for c in columns]
            held, size = [rest], len(rest[0])
            columns = [c[:cut] for c in columns]
        if len(columns[0]) == 0:
            return None
        new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])  # a class once
        columns = [c[new] for c in columns]
        token = columns[0]
        same = token[1:] == token[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return [c[keep] for c in columns] if keep.any() else None

    for batch in batches:
        if batch.num_rows:
            held.append([_values(c) for c in batch.columns])
            size += batch.num_rows
        if size > 400_000 and (got := ready(False)) is not None:
            yield got
        if size > 400_000:
            size = 0  # one group larger than this: look again after as many rows
    if (got := ready(True)) is not None:
        yield got


def _pair_batch(group: _Group, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    i = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    j = np.concatenate([p[1] for p in pairs]) if pairs else i
    a, b = np.minimum(group.cid[i], group.cid[j]), np.maximum(group.cid[i], group.cid[j])
    both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _all_pairs(columns: list[np.ndarray], num: int, den: int) -> tuple[_Group, list[tuple[np.ndarray, np.ndarray]]]:
    """All pairs of each group that pass the filters; groups are small."""
    by = np.lexsort((columns[2], columns[0]))
    group = _Group([c[by] for c in columns], num, den)
    at = np.arange(len(by))
    pairs, step = [], 0
    while len(at):
        step += 1
        at = at[at + step < len(by)]
        at = at[(group.token[at] == group.token[at + step]) & (den * group.n[at] >= num * group.n[at + step])]  # sizes rise: no later one fits either
        good = at[group.may_link(at, at + step)]
        pairs.append((good, good + step))
    return group, pairs


def _leader_pairs(index: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of members with the least and greatest class of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches):
            group = _Group(columns, num, den)
            head = np.concatenate([[True], group.token[1:] != group.token[:-1]])
            starts = np.flatnonzero(head)
            sizes = np.diff(np.append(starts, len(head)))
            member = np.arange(len(head))
            pairs = []
            for leader in (np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)):
                other = member != leader
                i, j = leader[other], member[other]
                good = group.may_link(i, j)
                pairs.append((i[good], j[good]))
            yield _pair_batch(group, pairs)

    rows = index.select("token", "cid", "n", "pos", "s1", "s2").repartition("token").sortWithinPartitions("token", "cid")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _cross_pairs(index: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Candidate pairs whose ends are in different components; on request nearest partners only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches):
            by = np.lexsort((columns[2], columns[0]))
            columns = [c[by] for c in columns]
            group, component = _Group(columns, num, den), columns[6]
            starts = np.flatnonzero(np.concatenate([[True], group.token[1:] != group.token[:-1]]))
            ends = np.append(starts[1:], len(group.token))
            of = np.repeat(np.arange(len(starts)), ends - starts)
            mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            large = mixed & (ends - starts > 256)
            pairs = []
            i = np.flatnonzero((mixed & ~large)[of])
            step = 0
            while len(i):
                step += 1
                i = i[i + step < ends[of[i]]]
                i = i[den * group.n[i] >= num * group.n[i + step]]  # sizes rise: no later one fits either
                good = i[component[i] != component[i + step]]
                good = good[group.may_link(good, good + step)]
                pairs.append((good, good + step))
            if nearest and pairs:
                pairs = [group.nearest(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))]
            for g in np.flatnonzero(large):
                a, b = int(starts[g]), int(ends[g])
                names, counts = np.unique(component[a:b], return_counts=True)
                for x in a + np.flatnonzero(component[a:b] != names[counts.argmax()]):
                    others = a + np.flatnonzero(component[a:b] != component[x])
                    mine = np.full(len(others), x)
                    good = group.may_link(mine, others)
                    mine, others = mine[good], others[good]
                    if nearest and len(mine):
                        one = group.apart(mine, others).argmin()
                        mine, others = mine[one : one + 1], others[one : one + 1]
                    pairs.append((mine, others))
            yield _pair_batch(group, pairs)

    rows = index.select("token", "cid", "n", "pos", "s1", "s2", "component", "sketch").repartition("token").sortWithinPartitions("token", "cid")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _apart(index: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Index rows of shingles whose classes are in different components, with component and sketch."""
    left = index.join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = left.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    return left.join(mixed, "token", "left_semi").join(marks.select("cid", "sketch"), "cid")


def _plausible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            need = -(-num * total // (num + den))
            good = pa.array(_sketch_distance(_values(batch.column(4)), _values(batch.column(5))) <= total - 2 * need)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    side = lambda x, n, s: marks.select(F.col("cid").alias(x), F.col("n").alias(n), F.col("sketch").alias(s))
    joined = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return joined.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, text: str) -> DataFrame:
    """Links (u, v) among the pairs, decided on the whole sets."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_tables.SLOTS, np.int64)
        for batch in batches:
            for c in batch.columns:
                counts[_tables.slot_of(c.to_numpy().view(np.uint64))] = 1
        parts, data = _tables.parts_of(counts)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    table = docs.sparkSession.sparkContext.broadcast(_tables.sum_parts(pairs.select("a", "b").mapInArrow(mark, "part int, data binary")) > 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = table.value, set()
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                cids, data = [], []
                for found in shingle_sets(batch.column(0).slice(a, b - a), k):
                    if len(found) and wanted[int((cid := _class_id(found)).view(np.uint64)) >> 44] and int(cid) not in seen:
                        seen.add(int(cid))
                        cids.append(int(cid))
                        data.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(data, pa.binary())], ["cid", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good[i] = den * common >= num * (len(x) + len(y) - common)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(sets, "cid long, set binary").groupBy("cid").agg(F.first("set").alias("set"))
    # Written first: a join of two plain shuffles can split a class with many pairs.
    found = materialize(found, "verified-sets")
    joined = pairs.join(found.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(found.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "u long, v long")


def similar_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links) of every row.

    Two documents link when den * |intersection| >= num * |union|.
    """
    first = materialize(_signatures(docs, k, doc_id, text), "sets")
    rows = first.where("part is null").select("doc_id", "n", "cid")
    counts = _tables.sum_parts(first.where("part is not null"))
    index = _prefixes(docs.where(F.col(doc_id).isNotNull()), k, num, den, counts, text)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "token", "cid", "n", "pos", "s1", "s2"]
        for columns in _whole_groups(batches):
            starts = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            sizes = np.diff(np.append(starts, len(columns[0])))
            large = np.repeat(sizes > SMALL_GROUP, sizes)
            small = [c[~large] for c in columns]
            pairs = _pair_batch(*_all_pairs(small, num, den))
            none, some = pa.nulls(pairs.num_rows, pa.int64()), int(large.sum())
            yield pa.RecordBatch.from_arrays([*pairs.columns, none, none, none, none.cast(pa.int32()), none, none], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(some, pa.int64()), pa.nulls(some, pa.int64()), *(pa.array(c[large]) for c in columns)], names)

    met = index.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(meet, "a long, b long, token long, cid long, n long, pos int, s1 long, s2 long")
    met = materialize(met, "index")
    done = materialize(met.where("a is not null").select("a", "b").distinct(), "pairs")
    same_id = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("v"), F.collect_set("cid").alias("all")).where("u <> v").select("u", F.explode("all").alias("v")).where("u <> v")
    marks = materialize(first.where("data is not null and part is null").groupBy("cid").agg(F.first("n").alias("n"), F.first("data").alias("sketch")), "sketches")
    likely = materialize(_plausible(done, marks, num, den), "pairs")
    groups = materialize(connected(_verify(likely, docs, k, num, den, text).unionByName(same_id)), "groups")
    index = met.where("token is not null").select("token", "cid", "n", "pos", "s1", "s2")
    more = None if index.isEmpty() else materialize(_leader_pairs(index, num, den).join(done, ["a", "b"], "left_anti"), "pairs")
    if more is not None and not more.isEmpty():
        likely = materialize(_plausible(more, marks, num, den), "pairs")
        if not likely.isEmpty():
            groups = _joined(groups, _verify(likely, docs, k, num, den, text))
        done = done.unionByName(more)
    turn = 0 if more is not None else NEAREST_ROUNDS + 1
    while turn <= NEAREST_ROUNDS:
        pairs = materialize(_cross_pairs(_apart(index, groups, marks), num, den, turn < NEAREST_ROUNDS).join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            turn = max(turn + 1, NEAREST_ROUNDS)  # to the complete round, or out
            continue
        groups = _joined(groups, _verify(pairs, docs, k, num, den, text))
        done = done.unionByName(pairs)
        turn += 1
    labelled = rows.join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = labelled.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    # Written first: a join of two plain shuffles can split a component with many rows.
    out = labelled.join(materialize(least, "least"), "component", "left")
    chosen = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), chosen.alias("component_id"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    return materialize(connected(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links)), "groups")


def connected(links: DataFrame) -> DataFrame:
    return _tables.connected_components(links)


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the least document id of each group; rows with a null id stay."""
    groups = similar_groups(docs, k, num, den, doc_id, text)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").dropDuplicates([doc_id, text])
