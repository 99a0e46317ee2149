"""Multiset comparisons of token texts within their rows, token totals, and wildcard matching."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import ILLEGIBLE
from folioscope.functions.batches import pieces


def token_counts(df: DataFrame, keys: list[str], tokens: Column | str, count: str = "n") -> DataFrame:
    """(keys, token, n): the multiset of each row's tokens."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(count))


def supports(pages: DataFrame, keys: list[str], ref: Column, out: Column) -> DataFrame:
    """(keys, matched, reference, output) of rows that hold both texts, as tokens with one space between.

    Tokens are counted where their row is: what is shuffled later is three numbers a row.
    A batch is counted in pieces, as its tokens take several times its bytes.
    """
    kinds = dict(pages.dtypes)
    names = [*keys, "matched", "reference", "output"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "matched long", "reference long", "output long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(*piece) for whole in batches for piece in pieces(*whole.columns[len(keys) :])):
            found = [_token_codes(batch.column(len(keys) + side)) for side in (0, 1)]
            sizes = [np.bincount(row, minlength=batch.num_rows) for row, _ in found]
            # Equal tokens of both sides get equal codes.
            both = pa.chunked_array([tokens for _, tokens in found]).dictionary_encode().unify_dictionaries()
            codes = [c.indices.to_numpy().astype(np.int64) for c in both.chunks]
            width = max((len(c.dictionary) for c in both.chunks), default=0) + 1
            a, b = (np.unique(row * width + code, return_counts=True) for (row, _), code in zip(found, codes, strict=True))
            common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
            matched = np.bincount(common // width, weights=np.minimum(a[1][i], b[1][j]), minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(matched), pa.array(sizes[0]), pa.array(sizes[1])], names)

    return pages.select(*keys, ref.alias("__ref"), out.alias("__out")).mapInArrow(run, schema)


def _token_codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each token, and the tokens."""
    lists = pc.split_pattern(pc.fill_null(column, ""), " ")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    tokens = lists.flatten()
    row = np.repeat(np.arange(len(column)), sizes)
    some = pc.not_equal(tokens, "")
    return row[some.to_numpy(zero_copy_only=False)], tokens.filter(some)


def legible(tokens: Counter) -> Counter:
    return Counter({t: n for t, n in tokens.items() if ILLEGIBLE not in t})


def recall_support(ref: Counter, out: Counter) -> tuple[int, int]:
    """Matched and all reference tokens; each output token serves once."""
    return sum((ref & out).values()), ref.total()


def wildcard_matches(patterns: Counter, words: Counter) -> int:
    """The greatest number of one-to-one matches of illegible tokens with output tokens.

    A pattern matches a word of its length that agrees wherever the pattern is legible.
    Augmenting paths with counts, length by length.
    """
    by_length: dict[int, list[str]] = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    total = 0
    for length in {len(p) for p in patterns}:
        fits = {p: [w for w in by_length[length] if all(a in (ILLEGIBLE, b) for a, b in zip(p, w, strict=True))] for p in patterns if len(p) == length}
        free = {w: words[w] for w in by_length[length]}
        given: dict[str, Counter] = {w: Counter() for w in by_length[length]}

        def place(p: str, seen: set[str], fits=fits, free=free, given=given) -> bool:
            for w in fits[p]:
                if w in seen:
                    continue
                seen.add(w)
                if free[w]:
                    free[w] -= 1
                    given[w][p] += 1
                    return True
                for other in [q for q, n in given[w].items() if n and q != p]:
                    if place(other, seen):
                        given[w][other] -= 1
                        given[w][p] += 1
                        return True
            return False

        for p in fits:
            for _ in range(patterns[p]):
                if not place(p, set()):
                    break
                total += 1
    return total


def extra_support(ref: Counter, out: Counter) -> tuple[int, int]:
    """Output tokens that neither an equal nor an illegible reference token accounts for, and all."""
    exact = legible(ref) & out
    patterns = Counter({t: n for t, n in ref.items() if ILLEGIBLE in t})
    left = out - exact
    return out.total() - exact.total() - (wildcard_matches(patterns, left) if patterns else 0), out.total()
