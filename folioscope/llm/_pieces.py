"""Space-delimited pieces of texts, encoded once each.

Both tokenizers here never merge across an ASCII space that stands between two
other characters, so a text is the concatenation of its pieces' encodings.  A
worker keeps the encoding of every piece it has met (emptied at a fixed size).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class PieceStore:
    """Growing flat store: piece -> ids, found through a dictionary of slots.

    ``encode`` returns the ids of all pieces one after the other, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 300_000) -> None:
        self.encode, self.keep = encode, keep
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.used = 0

    def slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.slot) > self.keep:
            self.clear()
        slot = self.slot
        found = np.fromiter((slot.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys([pieces[i] for i in missing.tolist()]))
            self.add(new, *self.encode(new))
            found[missing] = [slot[pieces[i]] for i in missing.tolist()]
        return found

    def add(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Put different pieces in that are not there yet."""
        k = len(self.slot)
        if k + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(new), np.int64)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[k + 1 : k + 1 + len(new)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.slot.update(zip(new, range(k, k + len(new)), strict=True))

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of the slots, and how many each has."""
        starts = self.ends[slots]
        counts = self.ends[slots + 1] - starts
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - counts), counts)
        return self.ids[at], counts


class RecentStore(PieceStore):
    """Pieces and the parts they are cut into, in one store; when full it keeps what was met again since it last was.

    ``cut`` returns of new pieces those that are parts themselves, the others, the parts
    of these, and how many each has; ``encode`` is asked for parts only.
    """

    def __init__(self, cut: Callable[[list[str]], tuple[list[str], list[str], list[str], list[int]]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int) -> None:
        self.cut = cut
        super().__init__(encode, keep)

    def clear(self) -> None:
        super().clear()
        self.again = np.zeros(1 << 12, bool)

    def add(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        super().add(new, ids, counts)
        if len(self.slot) > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(len(self.slot), bool)])

    def forget(self) -> None:
        """Keep the pieces met again, or none where they would fill the store."""
        kept = np.flatnonzero(self.again[: len(self.slot)])
        names = np.array(list(self.slot), object)[kept].tolist()
        ids, counts = self.gather(kept)
        self.clear()
        if len(kept) <= self.keep * 7 // 10:
            self.add(names, ids, counts)

    def slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.slot) > self.keep:
            self.forget()
        slot, before = self.slot, len(self.slot)
        found = np.fromiter(map(slot.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.again[found[found >= 0]] = True
        missing = np.flatnonzero(found < 0)
        if len(missing):
            asked = list(map(pieces.__getitem__, missing.tolist()))
            single, others, parts, sizes = self.cut(list(dict.fromkeys(asked)))
            new = list(dict.fromkeys(single + [p for p in parts if p not in slot]))
            self.add(new, *self.encode(new))
            at = np.fromiter(map(slot.__getitem__, parts), np.int64, len(parts))
            self.again[at[at < before]] = True
            # A piece may be its own only part, or another piece's part.
            left = np.fromiter((p not in slot for p in others), bool, len(others))
            ids, counts = self.gather(at[np.repeat(left, sizes)])
            last = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[left])])]
            self.add([p for p, x in zip(others, left.tolist(), strict=True) if x], ids, np.diff(last))
            found[missing] = np.fromiter(map(slot.__getitem__, asked), np.int64, len(asked))
        return found


def split_spaces(column: pa.Array, first: str, later: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, the code of each piece in text order, and pieces per text.

    ``first`` goes before a text's first piece and ``later`` before the others.
    """
    lists = pc.split_pattern(column, " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    raw = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.cumsum(counts) - counts
    heads = heads[counts > 0]
    head_codes, back = np.unique(codes[heads], return_inverse=True)
    codes[heads] = len(raw) + back
    # Through numpy, which makes Python strings several times faster than ``to_pylist``.
    with_front = lambda front, part: pc.binary_join_element_wise(front, part, "").to_numpy(zero_copy_only=False).tolist()
    return with_front(later, raw) + with_front(first, raw.take(pa.array(head_codes))), codes, counts
