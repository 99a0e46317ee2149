"""Arrow batches of texts in pieces: what Python holds at once depends on bytes, not on rows.

A batch may have ten thousand rows and so some hundred MB of text, of which Python's own
strings, lists and results would be several copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text of a piece; a longer text is a piece of its own.
MOST_BYTES = 1 << 20


def pieces(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of consecutive pieces of rows with these texts."""
    upto = np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    first = 0
    while first < len(upto):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + MOST_BYTES, "right")))
        yield first, last - first
        first = last


def text_map(kind: T.DataType) -> Callable:
    """A decorator: a function of lists of texts (a piece each) that returns a list of values becomes a column function."""
    made = to_arrow_type(kind)

    def wrap(function: Callable[..., list]):
        @F.arrow_udf(kind)
        def run(*texts: pa.Array) -> pa.Array:
            texts = tuple(t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t for t in texts)
            done = [pa.array(function(*(t.slice(at, n).to_pylist() for t in texts)), made) for at, n in pieces(*texts)]
            return pa.concat_arrays(done) if done else pa.array([], made)

        return run

    return wrap
