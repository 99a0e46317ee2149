"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

File format (little endian)::

    b"FTS1"
    block*:  uint32 n_docs, n_ids, n_ranks, n_data
             int64[n_docs] doc ids, uint8[n_docs] "doc id is null"
             uint32[n_docs] ids per document (end id included)
             uint32[n_ranks] rank -> token id, by falling count in the block, then id
             uint8[(n_ids + 3) // 4] control bytes, two bits an id: bytes minus one
             uint8[n_data] the ranks, one to four bytes each

A block holds whole documents of at most ``BLOCK_IDS`` ids (a longer document is a
block of its own), so readers and writers need memory for one block.  Each block
ranks its own ids: it can be read alone, and no pass over the corpus comes first.
File ``n`` holds the n-th range of document ids; the files in order hold all
documents by ascending id.

Defined results: a null text is empty and has the end id only; rows of equal ids
stand next to each other, ordered by text; null ids come first; other columns are
ignored; an empty table gives no file; a very long text is encoded whole and has a
block of its own size.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import _files
from folioscope.llm._common import chunks, fresh_dir
from folioscope.llm._pieces import RecentStore, split_spaces

MAGIC = b"FTS1"
BLOCK_IDS = 1 << 21
END_ID = 0
#: Text bytes encoded at a time: the more, the fewer distinct pieces a byte.
ENCODE_BYTES = 6 << 20
#: Lengths of the four ids of each control byte, and of all of them.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


# -- tokenizing ----------------------------------------------------------------


class ByteEncoder:
    """The tokenizers library on distinct words only.

    The library's pattern always cuts before a space that stands between two other
    characters, so space-delimited pieces can be encoded alone.  A new piece is cut by
    the same pattern, and the library's model encodes each distinct part of it once.
    Texts with two spaces in a row or with the string of a special token go to the
    library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The printable character that stands for each byte, as the library writes it.
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes: dict[int, str] = {}
        for point in range(0x800):
            raw = chr(point).encode()
            self.bytes |= dict(zip(raw, written(chr(point))[0][0], strict=True))
        for point in range(0x800, 0x110000, 0x800):
            if not 0xD800 <= point < 0xE000:
                self.bytes |= dict(zip(chr(point).encode(), written(chr(point))[0][0], strict=True))
        self.space = self.bytes[ord(" ")]
        self.store = RecentStore(self._cut, self._tokenize, keep=700_000)

    def _tokenize(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the pattern does not cut further."""
        tokenize, table, space, id_of = self.model.tokenize, self.bytes, self.space, attrgetter("id")
        # Printable characters of ASCII stand for themselves, but for the space.
        written = (p.replace(" ", space) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(table) for p in parts)
        ids: list[int] = []
        ends = []
        for w in written:  # one list: many small ones keep the garbage collector busy
            ids += map(id_of, tokenize(w))
            ends.append(len(ids))
        return np.array(ids, np.int32), np.diff(np.array(ends, np.int64), prepend=0)

    def _cut(self, pieces: list[str]) -> tuple[list[str], list[str], list[str], list[int]]:
        """Pieces that the pattern does not cut, the others, their parts, and how many each has."""
        single: list[str] = []
        others: list[str] = []
        parts: list[str] = []
        sizes: list[int] = []
        for piece in pieces:
            if piece[1:].isalpha() and piece[0] == " ":
                single.append(piece)
                continue
            if piece[-1:] in ",.;:!?|)" and piece[1:-1].isalpha() and piece[0] == " ":
                parts += (piece[:-1], piece[-1])
                sizes.append(2)
            else:
                found = self.cut(piece)
                parts += found
                sizes.append(len(found))
            others.append(piece)
        return single, others, parts, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring(column, "  ")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", column) if len(odd_rows) else column
        pieces, codes, n_pieces = split_spaces(plain, "", " ")
        ids, sizes = self.store.gather(self.store.slots(pieces)[codes])
        counts = np.bincount(np.repeat(np.arange(len(n_pieces)), n_pieces), weights=sizes, minlength=len(n_pieces)).astype(np.int64)
        if len(odd_rows):
            found = self.library.encode_batch_fast(column.take(pa.array(odd_rows)).to_pylist(), add_special_tokens=False)
            starts = np.concatenate([[0], np.cumsum(counts)])
            parts, at = [], 0
            for r, e in zip(odd_rows, found, strict=True):
                parts += [ids[at : starts[r]], np.array(e.ids, np.int32)]
                at = starts[r]
                counts[r] = len(e.ids)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, counts


@functools.lru_cache(2)
def encoder_of(path: str) -> ByteEncoder:
    """One encoder a worker process: what it has met serves the process's later tasks."""
    return ByteEncoder(path)


# -- coding --------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of non-negative 32-bit numbers."""
    ranks = ranks.astype(np.uint32)
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(codes.astype(np.int64) + 1)
    starts = ends - codes - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(4):
        has = codes >= j
        data[starts[has] + j] = ranks[has] >> np.uint32(8 * j) & np.uint32(0xFF)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers again; lengths come from a table indexed by control byte."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    out = data[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for j in range(1, 4):
        has = np.flatnonzero(lengths > j)
        if len(has) == 0:
            break
        out[has] |= data[starts[has] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def write_block(out, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    seen = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    used = np.flatnonzero(seen)
    by_rank = used[np.lexsort((used, -seen[used]))].astype(np.uint32)
    rank_of = np.zeros(len(seen), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank_of[ids])
    out.write(np.array([len(doc_ids), len(ids), len(by_rank), len(data)], "<u4").tobytes())
    for part in (doc_ids.astype("<i8"), nulls.astype(np.uint8), counts.astype("<u4"), by_rank.astype("<u4"), control, data):
        out.write(part.tobytes())


def read_blocks(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, null flags, ids per document, ids) of each block."""
    if file.read(4) != MAGIC:
        raise ValueError("not a token file")
    while head := file.read(16):
        n_docs, n_ids, n_ranks, n_data = np.frombuffer(head, "<u4").tolist()
        take = lambda n, kind: np.frombuffer(file.read(n * np.dtype(kind).itemsize), kind)
        doc_ids, nulls, counts, by_rank = take(n_docs, "<i8"), take(n_docs, "u1"), take(n_docs, "<u4"), take(n_ranks, "<u4")
        control, data = take(-(-n_ids // 4), "u1"), take(n_data, "u1")
        ranks = unpack(control, data, n_ids)
        yield doc_ids, nulls.astype(bool), counts, by_rank[ranks] if n_ids else ranks


# -- Spark ---------------------------------------------------------------------


def write(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Tokenize and write; returns one row per file: file_no, path, n_docs, n_ids.

    One range shuffle orders the documents; each task streams its range into a file.
    """
    folder = folder or fresh_dir(df.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encoder, path = encoder_of(tokenizer_path), f"{folder}/ids-{number:06d}.fts"
        n_docs = n_ids = 0
        held: list[tuple] = []
        first = next(batches, None)
        if first is None:
            return
        with _files.create(path) as out:
            out.write(MAGIC)

            def flush() -> None:
                if held:
                    write_block(out, *(np.concatenate([h[i] for h in held]) for i in range(4)))
                    held.clear()

            def all_batches() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for batch in all_batches():
                keys = batch.column(0)
                nulls = keys.is_null().to_numpy(zero_copy_only=False)
                values = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
                for a, b in chunks(batch.column(1), ENCODE_BYTES):
                    ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                    counts += 1
                    full = np.full(len(ids) + len(counts), END_ID, np.int32)
                    ends = np.cumsum(counts)
                    body = np.ones(len(full), bool)
                    body[ends - 1] = False
                    full[body] = ids
                    if held and sum(len(h[3]) for h in held) + len(full) > BLOCK_IDS:
                        flush()
                    held.append((values[a:b], nulls[a:b], counts, full))
                    n_docs, n_ids = n_docs + b - a, n_ids + len(full)
            flush()
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "file_no int, path string, n_docs long, n_ids long")


def read(spark: SparkSession, files: list[tuple[int, str, int, int]], with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and ``ids`` on request."""
    files = sorted(files)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not files:
        return spark.createDataFrame([], schema)
    starts = np.concatenate([[0], np.cumsum([f[3] for f in files])]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                with _files.open_at(path) as file:
                    for doc_ids, nulls, counts, ids in read_blocks(file):
                        counts = counts.astype(np.int64)
                        ends = np.cumsum(counts)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                        out = [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                        if with_ids:
                            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                        start += len(ids)

    table = spark.createDataFrame([(f[1], s) for f, s in zip(files, starts, strict=False)], "path string, start long")
    return table.repartition(min(len(files), 10_000)).mapInArrow(run, schema)


def write_and_read(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """The whole round trip; the driver holds one small row per file."""
    files = [tuple(r) for r in write(df, tokenizer_path).collect()]
    return read(df.sparkSession, files)
