"""Helpers shared by the operators: shared storage, Arrow text access, byte hashing.

All hashing is 64-bit polynomial hashing over bytes, evaluated for a whole Arrow
batch at once: ``prefix`` holds running sums, so the hash of any byte range costs
one subtraction and one multiplication.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer single text is a pass of its own.
CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        # Local runs and tests only: a cluster names its shared folder.
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes, one row at least."""
    n = len(column)
    if n == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to
        at = to


def text_bytes(column: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), each followed by ``tail``, and n + 1 offsets."""
    column = pc.fill_null(column, "")
    if tail:
        column = pc.binary_join_element_wise(column, "", tail.decode())
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    base = _BASE_INV if inverse else _BASE
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n + n // 8, 1 << 18), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random odd-ish 64-bit value for each byte; A-Z as a-z on request."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold_case:
        table[65:91] = table[97:123]
    return table


def prefix_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


#: Words of more bytes are hashed by BLAKE2: modulo 2^64 a polynomial gives some long
#: texts over two letters (from 1,024 bytes on) one value, whatever its base.
LONG_WORD = 64


def word_hashes(data: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, A-Z read as a-z (as ``table`` has it)."""
    out = range_hashes(prefix_hashes(data, table), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        raw = data[starts[i] : ends[i]].tobytes().lower()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return out


#: Two primes below 2^31: their range hashes together have 62 bits and no such texts.
_PRIMES = (2_147_483_629, 2_147_483_587)


@functools.cache
def _prime_powers(prime: int, base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo ``prime``, doubled up."""
    out = np.ones(size, np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
        have += more
    return out


def prime_hashes(data: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes of byte ranges: polynomials modulo two primes."""
    size = 1 << max(18, int(len(data)).bit_length())
    out = np.zeros(len(starts), np.uint64)
    for prime, base in zip(_PRIMES, (1_103_515_245, 1_664_525_003), strict=True):
        p = np.uint64(prime)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((table % p)[data] * _prime_powers(prime, base, size)[: len(data)] % p, out=sums[1:])
        found = (sums[ends] - sums[starts]) % p * _prime_powers(prime, pow(base, -1, prime), size)[starts] % p
        out = out << np.uint64(31) | found
    return out


def in_share(column: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into the given share of all hashes, however small."""
    if share >= 1.0:
        return F.lit(True)
    return column < F.lit(int(share * 2**64) - 2**63)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[data]
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, wherever it starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(h)


def hex_of(digests: list[bytes]) -> list[str]:
    return [d.hex() for d in digests]
