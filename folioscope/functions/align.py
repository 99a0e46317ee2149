"""Edit counts of two texts by bit-parallel alignment.

Column bit vectors (one Python integer for all rows) give the distance in a few integer
operations per character; the stored vectors give the alignment.  Only a band of diagonals
around the main one is computed, widened until the distance fits into it, and equal
stretches are passed in one step, so near texts cost their distance times some columns
round each edit.  Pairs that are far apart take the whole matrix; long ones are halved at
the best split first, so memory stays bounded.  Among minimal alignments, going back
from the ends, a deletion is taken before an insertion and an insertion before a
diagonal step.  The distance never depends on that; with illegible characters the
discounted counts may.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from folioscope.constants import ILLEGIBLE
from folioscope.functions import batches

#: Cells (reference times output) that one alignment stores; more are halved.
MOST_CELLS = 1 << 27
#: Diagonals of the first band beyond those that the lengths ask for; more until the distance fits.
FIRST_SLACK = 32
#: Columns for which a character's places are cut out at once.
_NEAR = 256


def _where(ref: str) -> dict[str, int]:
    """For each character, the bits of its places."""
    if len(ref) < 300:
        where: dict[str, int] = {}
        for i, c in enumerate(ref):
            where[c] = where.get(c, 0) | 1 << i
        return where
    codes = np.array([*map(ord, ref)], np.uint32)
    return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(ref)}


def _scores(ref: str, out: str) -> list[int]:
    """Distances of the whole reference to each prefix of the output."""
    full, top, get = (1 << len(ref)) - 1, len(ref) - 1, _where(ref).get
    up, down = full, 0  # rows whose value is one more, one less than the row above
    score, scores = len(ref), [len(ref)]
    for c in out:
        same = get(c, 0)
        zero = (((same & up) + up) ^ up | same | down) & full
        right, left = down | (full ^ (zero | up)), zero & up
        score += (right >> top & 1) - (left >> top & 1)
        right = (right << 1 | 1) & full
        up, down = left << 1 & full | (full ^ (zero | right)), right & zero
        scores.append(score)
    return scores


def _vectors(ref: str, out: str) -> tuple[list[int], list[int]]:
    """Each column's vectors ``up`` and ``down``, the empty output's first."""
    full, get = (1 << len(ref)) - 1, _where(ref).get
    up, down = full, 0
    ups, downs = [full], [0]
    for c in out:
        same = get(c, 0)
        zero = (((same & up) + up) ^ up | same | down) & full
        right = ((down | (full ^ (zero | up))) << 1 | 1) & full
        up, down = (zero & up) << 1 & full | (full ^ (zero | right)), right & zero
        ups.append(up)
        downs.append(down)
    return ups, downs


def distance(ref: str, out: str) -> int:
    if not ref or not out:
        return max(len(ref), len(out))
    return _scores(ref, out)[-1]


def operations(ref: str, out: str) -> tuple[bytes, int]:
    """One letter per reference character (h match, s substitution, d deletion), and insertions."""
    limit = min(len(ref), len(out))
    head = _same_length(ref, 0, out, 0, limit)
    tail = _same_length(ref[::-1], 0, out[::-1], 0, limit - head)
    middle, inserted = _align(ref[head : len(ref) - tail], out[head : len(out) - tail])
    return b"h" * head + middle + b"h" * tail, inserted


def _align(ref: str, out: str) -> tuple[bytes, int]:
    if not ref or not out:
        return b"d" * len(ref), len(out)
    slack = FIRST_SLACK
    while slack * 2 < min(len(ref), len(out)):
        if (found := _align_near(ref, out, slack)) is not None:
            return found
        slack *= 4
    return _align_far(ref, out)


def _same_length(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters of ``a`` from ``i`` and of ``b`` from ``j`` are the same, up to ``most``."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        x, y = a[i + done : i + done + step], b[j + done : j + done + step]
        if x == y:
            if len(x) < step:
                return done + len(x)
            done += step
            step *= 2
        elif step == 1 or not x or not y:
            return done
        else:
            step = step // 2 if len(x) == len(y) else max(1, min(len(x), len(y)))
            most = min(most, done + max(len(x), len(y)))
    return done


class _Band:
    """Column bit vectors of the diagonals from ``above`` over the main one to ``below`` under it.

    Column j has rows j - above to j + below; rows before the first hold the costs |row| + j,
    which no alignment gains by.  Where costs rise by one with every diagonal on both sides of
    one, they go on doing so while characters on it are the same: a diagonal's costs never fall,
    and neighbours differ by one at most.  Such runs take one step, however long they are.
    """

    def __init__(self, ref: str, out: str, above: int, below: int) -> None:
        self.ref, self.out, self.above = ref, out, above
        self.size = above + below + 1
        self.mask = (1 << self.size) - 1
        self.where = {c: bits << above for c, bits in _where(ref).items()}
        self.aim = len(ref) - len(out) + above  # the diagonal of the end

    def start(self) -> tuple[int, int]:
        high = (1 << self.above) - 1
        return self.mask ^ high, high

    def columns(self, first: int, last: int, up: int, down: int, most: int, kept: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int]:
        """Vectors after columns ``first`` + 1 to ``last``, and by how much the end's diagonal grows; stops above ``most``.

        ``kept`` gets (column, up, down) wherever vectors change, those of ``first`` included.
        """
        ref, out, mask, aim = self.ref, self.out, self.mask, 1 << self.aim
        near: dict[str, int] = {}
        since, room = first, (1 << (min(last - first, _NEAR) + self.size)) - 1
        grown, j = 0, first
        if kept is not None:
            kept.append((j, up, down))
        while j < last:
            if up ^ down == mask and not down & (down + 1):
                i = down.bit_length() + j - self.above
                if 0 <= i and (run := _same_length(ref, i, out, j, last - j)):
                    j += run
                    continue
            if j - since >= _NEAR:
                near, since = {}, j
            c = out[j]
            if (bits := near.get(c)) is None:
                bits = near[c] = self.where.get(c, 0) >> since & room
            same = bits >> (j - since) & mask
            zero = (((same & up) + up) ^ up | same | down) & mask
            right = down | (mask ^ (zero | up))
            left = zero & up
            if not zero & aim:
                grown += 1
                if grown > most:
                    break
            zero >>= 1
            up, down = left | (mask ^ (zero | right)), zero & right
            j += 1
            if kept is not None:
                kept.append((j, up, down))
        return up, down, grown


def _align_near(ref: str, out: str, slack: int) -> tuple[bytes, int] | None:
    """The alignment, if its distance is at most what the lengths differ by and twice ``slack``, less four.

    No best alignment leaves the diagonals between the first and the end's by more than half of
    what the distance exceeds the lengths' difference by; so all their cells and these cells'
    neighbours lie in the band, and it decides as the whole matrix does.  Vectors are kept for
    one block of columns at a time; the others are computed again from the vectors at their start.
    """
    n = len(out)
    band = _Band(ref, out, slack + max(0, n - len(ref)), slack + max(0, len(ref) - n))
    most = 2 * slack - 4
    block = max(256, MOST_CELLS // band.size)
    starts, (up, down) = [], band.start()
    kept: list[tuple[int, int, int]] = []
    for first in range(0, n, block):
        starts.append((up, down))
        kept = []
        up, down, grown = band.columns(first, min(first + block, n), up, down, most, kept)
        most -= grown
        if most < 0:
            return None
    steps = bytearray(b"h") * len(ref)
    i, j, inserted = len(ref), n, 0
    for number in range(len(starts) - 1, -1, -1):
        first = number * block
        if number < len(starts) - 1:
            kept = []
            band.columns(first, first + block, *starts[number], n, kept)
        k = len(kept) - 1
        while i and j > first:
            while kept[k][0] > j:
                k -= 1
            since, up, down = kept[k]
            place = i - j - 1 + band.above
            if up >> place & 1:
                i -= 1
                steps[i] = 100
                continue
            if since < j:  # a run: the vectors of the column before are these
                if down >> (place + 1) & 1:
                    j -= 1
                    inserted += 1
                else:  # on the run's diagonal
                    run = min(i, j - since)
                    i, j = i - run, j - run
            elif kept[k - 1][2] >> (place + 1) & 1:
                j -= 1
                inserted += 1
            else:
                i, j = i - 1, j - 1
                if ref[i] != out[j]:
                    steps[i] = 115
    steps[:i] = b"d" * i
    return bytes(steps), inserted + j


def _align_far(ref: str, out: str) -> tuple[bytes, int]:
    if len(ref) * len(out) > MOST_CELLS and len(ref) > 1:
        half = len(ref) // 2
        first = np.array(_scores(ref[:half], out))
        second = np.array(_scores(ref[half:][::-1], out[::-1]))[::-1]
        cut = int(np.argmin(first + second))
        a, b = operations(ref[:half], out[:cut]), operations(ref[half:], out[cut:])
        return a[0] + b[0], a[1] + b[1]
    ups, downs = _vectors(ref, out)
    steps = bytearray(len(ref))
    i, j, inserted = len(ref), len(out), 0
    while i and j:
        bit = 1 << (i - 1)
        if ups[j] & bit:
            i -= 1
            steps[i] = 100
        elif downs[j - 1] & bit:
            j -= 1
            inserted += 1
        else:
            i, j = i - 1, j - 1
            steps[i] = 104 if ref[i] == out[j] else 115
    steps[:i] = b"d" * i
    return bytes(steps), inserted + j


def _is_within(short: str, long: str) -> bool:
    """The characters of one text are in the other in their order."""
    i = at = 0
    while i < len(short):
        if (at := long.find(short[i], at)) < 0:
            return False
        run = _same_length(short, i, long, at, len(short) - i)
        i, at = i + run, at + run
    return True


def _only_counts(ref: str, out: str) -> tuple[int, int, int, int] | None:
    """The counts where all best alignments have the same: one text is within the other, or each changed character is one that the other text lacks."""
    more = len(out) - len(ref)
    if not more:
        if ref == out:
            return 0, 0, 0, len(ref)
        # An alignment with x deletions and x insertions costs at least x above what the characters' counts tell.
        counts = Counter(out)
        counts.subtract(ref)
        changed = sum(map(operator.ne, ref, out))
        return (changed, 0, 0, len(ref) - changed) if changed == sum(n for n in counts.values() if n > 0) else None
    if more > 0:
        return (0, 0, more, len(ref)) if _is_within(ref, out) else None
    return (0, -more, 0, len(out)) if _is_within(out, ref) else None


def edit_counts(ref: str, out: str) -> tuple[int, int, int, int]:
    """Substitutions, deletions, insertions and matches; illegible reference characters count nowhere."""
    if not ref:
        return 0, 0, len(out), 0
    if ILLEGIBLE not in ref and (counts := _only_counts(ref, out)) is not None:
        return counts
    steps, inserted = operations(ref, out)
    if ILLEGIBLE in ref:
        steps = bytes(s for s, c in zip(steps, ref, strict=True) if c != ILLEGIBLE)
    return steps.count(b"s"), steps.count(b"d"), inserted, steps.count(b"h")


COUNTS = T.StructType([T.StructField(k, T.LongType()) for k in "sdih"])


@batches.text_map(COUNTS)
def edit_counts_udf(ref: list, out: list) -> list:
    return [dict(zip("sdih", edit_counts(a or "", b or ""), strict=True)) for a, b in zip(ref, out, strict=True)]


def find_within(needle: str, text: str, most: int) -> list[tuple[int, int]]:
    """Ends (exclusive) in ``text`` where ``needle`` matches with at most ``most`` edits, and the edits."""
    m = len(needle)
    full = (1 << m) - 1
    where = _where(needle)
    up, down, score, found = full, 0, m, []
    for j, c in enumerate(text, 1):
        same = where.get(c, 0)
        zero = (((same & up) + up) ^ up | same | down) & full
        right, left = down | full & ~(zero | up), zero & up
        score += (right >> (m - 1) & 1) - (left >> (m - 1) & 1)
        right, left = right << 1 & full, left << 1 & full  # a match may start anywhere
        up, down = left | full & ~(zero | right), right & zero
        if score <= most:
            found.append((j, score))
    return found
