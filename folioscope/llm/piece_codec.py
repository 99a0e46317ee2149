"""SentencePiece (BPE with byte fallback) encoding and decoding in vectorised merge rounds.

All distinct words of a batch lie in one flat symbol array.  A round looks up the
merge rank of every adjacent pair, takes the minimum rank per word with a segmented
reduction, merges the leftmost occurrences of that rank at once, and compacts the
arrays; words without a mergeable pair leave.  A piece is merged at several places
in one round only if no piece of equal or better rank begins or ends with it, since
otherwise the library's priority queue could take that one in between; then only the
leftmost place is merged, so the results equal the library's.

Defined results: null and empty texts have no ids and decode to the empty text; rows
are independent, so ties, repeated rows and extra columns have no influence; an empty
table gives an empty result; very long texts are encoded whole; words
of over ``LONG_WORD`` symbols take their rounds over linked symbols, where a round costs
what it merges, which keeps the time near linear in the length of a text without spaces.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm._common import chunks
from folioscope.llm._pieces import PieceStore, split_spaces

SPACE = "▁"
LONG_WORD = 1024
#: Places of one rank that a round of a long word looks at.
NEAR = 4096
_NONE = np.iinfo(np.int32).max


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """Vocabulary, merge table and surfaces of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = f.read()
        names, scores, kinds = [], [], []
        self.dummy_prefix = True
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
                    raise ValueError("only BPE models with byte fallback are supported")
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models without text normalization are supported")
                self.dummy_prefix = bool(norm.get(3, 1))
        self.size = len(names)
        self.names = names
        self.byte_id = {int(names[i][3:5], 16): i for i in range(len(names)) if kinds[i] == 6}
        self.is_byte = np.array([k == 6 for k in kinds])
        normal = {n: i for i, n in enumerate(names) if kinds[i] == 1}
        if any(n[i] != SPACE and n[i + 1] == SPACE for n in normal for i in range(len(n) - 1)):
            raise ValueError("pieces that continue across a space are not supported")
        # Symbols: pieces, and characters that occur in pieces only.
        self.symbol = dict(zip(normal, range(len(normal)), strict=True))
        for n in normal:
            for c in n:
                self.symbol.setdefault(c, len(self.symbol))
        self.symbol_id = np.full(len(self.symbol), -1, np.int32)
        self.symbol_id[: len(normal)] = list(normal.values())
        self.symbol_text = list(self.symbol)
        order = sorted({-scores[i] for i in normal.values()})
        place = {s: r for r, s in enumerate(order)}
        rank = {n: place[-scores[i]] for n, i in normal.items()}
        careful = np.zeros(len(self.symbol), bool)
        pairs: dict[int, tuple[int, int]] = {}
        for n, r in rank.items():
            for i in range(1, len(n)):
                a, b = n[:i], n[i:]
                for part in (a, b):
                    if rank.get(part, -1) >= r:
                        careful[self.symbol[part]] = True
                if a in self.symbol and b in self.symbol:
                    pairs[self.symbol[a] << 20 | self.symbol[b]] = (r, self.symbol[n])
        self.careful = careful
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by = np.argsort(keys)
        self.keys = keys[by]
        self.pair_rank = np.fromiter((v[0] for v in pairs.values()), np.int32, len(pairs))[by]
        self.pair_to = np.fromiter((v[1] for v in pairs.values()), np.int32, len(pairs))[by]
        self.pairs = pairs
        top = max(ord(c) for c in self.symbol if len(c) == 1)
        self.char_symbol = np.full(top + 2, -1, np.int32)
        for c, s in self.symbol.items():
            if len(c) == 1:
                self.char_symbol[ord(c)] = s
        # What an id looks like on its own; bytes over 127 need their neighbours.
        self.surface = [n.replace(SPACE, " ") if kinds[i] in (1, 4) else "" for i, n in enumerate(names)]
        for i in range(self.size):
            if kinds[i] == 2:
                self.surface[i] = " ⁇ "
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.starts_space = np.fromiter((n.startswith(SPACE) for n in names), bool, self.size)
        self.alone_unclear = np.fromiter((k == 3 for k in kinds), bool, self.size)
        for byte, i in self.byte_id.items():
            self.surface[i] = chr(byte) if byte < 128 else ""
            self.alone_unclear[i] = byte >= 128
        self.byte_of = {i: byte for byte, i in self.byte_id.items()}

    # -- encoding -----------------------------------------------------------------

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 20 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), np.where(hit, self.pair_to[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after the other, and how many each has; spaces are U+2581."""
        text = "".join(w for w in words if len(w) <= LONG_WORD)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        known = self.char_symbol[np.minimum(points, len(self.char_symbol) - 1)]
        symbols = np.where(known >= 0, known, -1 - points)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), np.where(lengths > LONG_WORD, 0, lengths))
        done, word = self._rounds(symbols, word)
        long = np.flatnonzero(lengths > LONG_WORD)
        if len(long):
            extra = [self._long_rounds(words[i]) for i in long]
            done = np.concatenate([done, *extra])
            word = np.concatenate([word, np.repeat(long, [len(x) for x in extra])])
            by = np.argsort(word, kind="stable")
            done, word = done[by], word[by]
        return self._ids(done, word, len(words))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        finished = []
        rank = np.full(len(symbols), _NONE, np.int32)  # of the pair that starts here
        to = np.full(len(symbols), -1, np.int64)
        stale = np.ones(len(symbols), bool)
        while len(symbols):
            at = np.flatnonzero(stale[:-1])
            same = word[at] == word[at + 1]
            rank[stale] = _NONE
            at = at[same]
            rank[at], to[at] = self._lookup(symbols[at], symbols[at + 1])
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            least_of = np.repeat(least, np.diff(np.append(heads, len(word))))
            ended = least_of == _NONE
            if ended.any():
                finished.append((symbols[ended], word[ended]))
            at = np.flatnonzero((rank == least_of) & ~ended)
            # Of overlapping places (consecutive indices) every other one, from the left.
            run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            head = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))] if len(at) else at
            at = at[(at - head) % 2 == 0]
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]]) if len(at) else np.zeros(0, bool)
            at = at[first | ~self.careful[to[at]]]
            symbols[at] = to[at]
            stale = np.zeros(len(symbols), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = ~ended
            keep[at + 1] = False
            # A place left of a merge whose own symbol goes passes the mark to the merge before it.
            gone = at + 1
            onward = gone[stale[gone] & (gone + 1 < len(stale))]
            stale[onward - 1] = True
            symbols, word, rank, to, stale = symbols[keep], word[keep], rank[keep], to[keep], stale[keep]
        if not finished:
            return symbols, word
        symbols = np.concatenate([s for s, _ in finished])
        word = np.concatenate([w for _, w in finished])
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def _long_rounds(self, w: str) -> np.ndarray:
        """The same rounds over one long word: symbols are linked, places wait in a list per rank.

        A round looks only at the places of the least rank, so its cost does not depend on
        the word's length.
        """
        points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        known = self.char_symbol[np.minimum(points, len(self.char_symbol) - 1)]
        symbols = np.where(known >= 0, known, -1 - points)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        near: dict[int, int] = {}

        def offer(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[at] < n)]
            rank, _ = self._lookup(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            heads = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(at) else np.zeros(0, np.int64)
            for r, part in zip(rank[heads].tolist(), np.split(at, heads[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        offer(np.arange(n - 1))
        while waiting:
            r = heapq.heappop(waiting)
            parts = places.pop(r)
            if len(parts) > 16:
                parts = [np.unique(np.concatenate(parts))]
            # All places up to ``limit``; the rest stays as views, so it costs a round nothing.
            reach = near.get(r, NEAR)
            limit = min((int(p[reach]) for p in parts if len(p) > reach), default=n)
            at = parts[0][:reach] if len(parts) == 1 else np.unique(np.concatenate([p[:reach] for p in parts]))
            at = at[at < limit]
            at = at[alive[at]]
            at = at[after[at] < n]
            rank, to = self._lookup(symbols[at], symbols[after[at]])
            at, to = at[rank == r], to[rank == r]
            good = np.zeros(len(at), bool)
            if len(at):
                run = np.concatenate([[True], after[at[:-1]] != at[1:]])
                number = np.arange(len(at))
                good = (number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0
                if self.careful[to[good]].any():
                    # Up to the first merge whose piece may go on merging at once: what follows may change.
                    made = to[good]
                    left, right = before[at[good]], after[after[at[good]]]
                    beside = [np.where(left >= 0, symbols[left], -1), np.where(right < n, symbols[np.minimum(right, n - 1)], -1)]
                    next_rank = np.minimum.reduce([self._lookup(beside[0], made)[0], self._lookup(made, beside[1])[0], self._lookup(made, made)[0]])
                    restless = np.flatnonzero(next_rank <= r)
                    near[r] = 8 if len(restless) else min(2 * reach, NEAR)
                    if len(restless):
                        last = np.flatnonzero(good)[restless[0]]
                        good[last + 1 :] = False
                        limit = int(at[last]) + 1
            parts = [p[np.searchsorted(p, limit) :] for p in parts]
            if any(len(p) for p in parts):
                places[r] = [p for p in parts if len(p)]
                heapq.heappush(waiting, r)
            if not good.any():
                continue
            at, to = at[good], to[good]
            gone = after[at]
            symbols[at], alive[gone] = to, False
            following = after[gone]
            after[at] = following
            inner = following < n
            before[following[inner]] = at[inner]
            offer(np.unique(np.concatenate([before[at], at])))
        return symbols[alive]

    def _ids(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids; a character without one becomes its bytes' ids."""
        ids = np.where(symbols >= 0, self.symbol_id[np.maximum(symbols, 0)], -1)
        sizes = np.ones(len(ids), np.int64)
        spelled = {}
        for s in np.unique(symbols[ids < 0]).tolist():
            char = chr(-1 - s) if s < 0 else self.symbol_text[s]
            spelled[s] = [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]
            sizes[symbols == s] = len(spelled[s])
        starts = np.cumsum(sizes) - sizes
        out = np.repeat(ids, sizes).astype(np.int32)
        for s, parts in spelled.items():
            at = starts[symbols == s]
            for j, i in enumerate(parts):
                out[at + j] = i
        return out, np.bincount(word, weights=sizes, minlength=n_words).astype(np.int64)

    # -- decoding -----------------------------------------------------------------

    def decode_one(self, ids: np.ndarray) -> str:
        """One text from any ids; bytes that form no character become U+FFFD each."""
        out, pending = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(pending):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(pending[at : at + size].decode("utf-8"))
                        at += min(size, len(pending) - at)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            pending.clear()

        first = True
        for i in ids.tolist():
            if i in self.control:
                continue
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                first = False
                continue
            flush()
            s = self.surface[i]
            out.append(s[1:] if first and not out and self.dummy_prefix and self.names[i].startswith(SPACE) else s)
            first = False
        flush()
        return "".join(out)

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """Texts of many id lists: surfaces are gathered by id and joined per list."""
        flat = ids.flatten()
        values = flat.to_numpy(zero_copy_only=False)
        if not hasattr(self, "_surfaces"):
            self._surfaces = pa.array(self.surface, pa.string())
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self._surfaces.take(flat)), "")
        if self.dummy_prefix:
            headed = np.zeros(len(lengths), bool)
            some = lengths > 0
            headed[some] = self.starts_space[values[offsets[:-1][some]]]
            joined = pc.if_else(pa.array(headed), pc.utf8_slice_codeunits(joined, 1), joined)
        high = np.concatenate([[0], np.cumsum(self.alone_unclear[values])])
        odd = np.flatnonzero(high[offsets[1:]] > high[offsets[:-1]])
        if len(odd):
            texts = joined.to_pylist()
            for r in odd:
                texts[r] = self.decode_one(values[offsets[r] : offsets[r + 1]])
            joined = pa.array(texts, pa.string())
        return joined


class Encoder:
    """Encodes Arrow text columns; distinct words go through the merge rounds once."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.store = PieceStore(self.model.encode_words)

    def _words(self, text: str) -> list[str]:
        """A text's words where spaces follow each other or U+2581 occurs."""
        text = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        cuts = [0, *(i for i in range(1, len(text)) if text[i] == SPACE and text[i - 1] != SPACE), len(text)]
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, column: pa.Array) -> pa.ListArray:
        column = pc.fill_null(column, "")
        odd = pc.or_(pc.match_substring(column, "  "), pc.or_(pc.match_substring(column, SPACE), pc.starts_with(column, " ")))
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        plain = pc.if_else(odd, "", column) if len(odd_rows) else column
        pieces, codes, counts = split_spaces(plain, SPACE if self.model.dummy_prefix else "", SPACE)
        skip = empty.copy()
        skip[odd_rows] = True
        slots = self.store.slots(pieces)
        ids, sizes = self.store.gather(slots[codes])
        row = np.repeat(np.arange(len(counts)), counts)
        lengths = np.bincount(row, weights=sizes, minlength=len(counts)).astype(np.int64)
        if skip.any():  # an empty text still splits into one piece
            ids = ids[np.repeat(~skip, lengths)]
            lengths[skip] = 0
        if len(odd_rows):
            words = [self._words(t) for t in column.take(pa.array(odd_rows)).to_pylist()]
            of_words, word_sizes = self.store.gather(self.store.slots([w for ws in words for w in ws]))
            last = np.concatenate([[0], np.cumsum(word_sizes)])[np.concatenate([[0], np.cumsum([len(ws) for ws in words])])]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            parts, at = [], 0
            for k, r in enumerate(odd_rows):
                parts += [ids[at : starts[r]], of_words[last[k] : last[k + 1]]]
                at = starts[r]
                lengths[r] = last[k + 1] - last[k]
            ids = np.concatenate([*parts, ids[at:]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: words it has met serve the process's later tasks."""
    return Encoder(path)


def _schema(df: DataFrame, keep: list[str], extra: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + extra)


def round_trip(df: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``ids`` array<int> and ``decoded`` string, which decodes those ids.

    Texts are handled whole, in passes of bounded size; one pass over the input, no shuffle.
    """
    schema = _schema(df, keep, [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path)
        names = [f.name for f in schema]
        for batch in batches:
            texts = batch.column(n_keep)
            for a, b in chunks(texts):
                ids = encoder.encode(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n_keep)), ids, encoder.model.decode_lists(ids)], names)

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``."""
    return round_trip(df, model_path, keep, text).drop("decoded")


def decode(df: DataFrame, model_path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``decoded``, the texts of id lists (null: empty)."""
    schema = _schema(df, keep, [T.StructField("decoded", T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder_of(model_path).model
        for batch in batches:
            lists = batch.column(n_keep)
            for a in range(0, len(lists), 512):
                part = lists.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, 512) for i in range(n_keep)), model.decode_lists(part)], [f.name for f in schema])

    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(run, schema)
