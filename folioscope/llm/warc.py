"""WARC archives of web pages, and an external merge of their capture index.

Writing: each task sorts its captures by URL key and timestamp and writes them as one run
file, a gzip member per record; its index entries (key, time, run, offset, length) come
out in the same order.  Records whose payload another record holds are revisits.

Merging: the entries are dealt into ranges of (URL key, timestamp).  In each range a loser
tree merges the slices of all runs; every slice is sorted and contiguous in its file, so
each run is read forwards only.  The ranges in order are the global capture histories.

Defined results: a null payload is empty; among equal payloads of at least ``min_bytes``
bytes the greatest page id is the response and the others refer to it (rows that share
that id are all responses, rows with a null id are revisits unless all ids are null);
a null URL has an empty key; ties in key and time are ordered by page id, then run;
repeated rows are records of their own; very long payloads are one record; other columns
are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _files
from folioscope.llm._common import fresh_dir, materialize

#: Run files that a merging task keeps open.
OPEN_FILES = 128
#: Archive bytes that a merging task reads, about.
RANGE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class LoserTree:
    """Merges k sorted iterators; ties go to the earlier iterator.

    ``tree[0]`` is the winner, the other nodes hold the loser of the match played there.
    An element costs one comparison per level.
    """

    def __init__(self, sources: list[Iterator[tuple]]) -> None:
        self.sources = sources
        self.k = len(sources)
        self.heads: list[tuple | None] = [next(s, None) for s in sources]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                if building:  # wait here for the other side
                    self.tree[node] = winner
                    return
            elif self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.tree[0]]) is not None:
            leaf = self.tree[0]
            yield head
            self.heads[leaf] = next(self.sources[leaf], None)
            self._replay(leaf)


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query, lower-cased, without scheme, www, user, port and fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/@?#]*@)?(?:[wW]{3}\.)?([^/:?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#]*)", 1))
    return F.when(host == "", F.lower(url)).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def encode_record(page_id: int | None, url: str | None, date: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; ``payload`` None makes a revisit of the given size and digest."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), body


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def decode_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, record type, refers to) as the record says.

    A response's payload is measured and hashed again.
    """
    head, body = _headers(zlib.decompress(member, 31))
    http, payload = _headers(body[: int(head["Content-Length"])])
    kind = head["WARC-Type"]
    if kind == "response":
        digest = digest_of(hashlib.sha1(payload).digest())
        if head["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError("payload and digest differ")
        return _page_of(head["WARC-Record-ID"]), len(payload), digest, kind, None
    return _page_of(head["WARC-Record-ID"]), int(http["Content-Length"]), head["WARC-Payload-Digest"][5:], kind, _page_of(head["WARC-Refers-To"])


def plan_records(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> DataFrame:
    """url_key, ts, page_id, url, payload (null in revisits), size, sha1, refers_to, same (SHA-256).

    ``captured`` is a timestamp; without one, seconds from a fixed day stand for it, one a page id.
    """
    ts = captured if captured is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(page_id), F.lit(0)))
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), url_key(F.col(url)).alias("url_key"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("same"), F.octet_length(body).cast("long").alias("size"))
    last = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha2(body, 256).alias("same")).groupBy("same").agg(F.max("page_id").alias("last"))
    # Written first: a join of two plain shuffles can split a payload that many pages share.
    last = materialize(last, "payloads")
    response = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(last, "same").select("url_key", "ts", "page_id", "url", F.when(response, F.col("payload")).alias("payload"), "size", "sha1", F.when(~response, F.col("last")).alias("refers_to"), "same")


_INDEX = "url_key string, ts string, page_id long, run int, path string, offset long, length long"


def write_runs(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write run files; returns their index entries, each run's in order.

    A run's name holds the attempt that wrote it, and so do its entries: a task that runs
    again never shares a file with entries of its first attempt.
    """
    folder = folder or fresh_dir(records.sparkSession, "warc")
    names = [f.split()[0] for f in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId()
        path = f"{folder}/run-{number:06d}-{task.taskAttemptId()}.warc.gz"
        first = next(batches, None)
        if first is None:
            return
        with _files.create(path) as out:
            at = 0
            batch = first
            while batch is not None:
                places = []
                for page_id, url, ts, payload, size, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in (2, 3, 1, 4, 5, 6, 7)), strict=True):
                    record = encode_record(page_id, url, ts, payload, size, digest_of(bytes.fromhex(sha1)), refers_to)
                    out.write(record)
                    places.append((at, len(record)))
                    at += len(record)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([number] * n, pa.int32()), pa.array([path] * n, pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())], names)
                batch = next(batches, None)

    return records.sortWithinPartitions("url_key", "ts", "page_id", "same", "url").mapInArrow(run, _INDEX)


class _Runs:
    """Reads records of many run files, a limited number of them open."""

    def __init__(self) -> None:
        self.open: dict[str, object] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        file = self.open.pop(path, None) or _files.open_at(path)
        self.open[path] = file  # the latest goes last
        if len(self.open) > OPEN_FILES:
            self.open.pop(next(iter(self.open))).close()
        return file.read_at(length, offset)


def merge_histories(index: DataFrame, read: bool = True) -> DataFrame:
    """All captures in global order of (url_key, ts, page_id): by ``shard``, then ``position``.

    With ``read``, each capture's record is read from its run as it is merged: payload_bytes,
    payload_digest, record_type, refers_to.  A range holds about ``RANGE_BYTES`` of archive,
    and ties in key, time and id are dealt by run, so what a task merges is bounded.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    ranges = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    schema = "url_key string, ts string, page_id long, shard int, position long" + (", payload_bytes long, payload_digest string, record_type string, refers_to long" if read else ", path string, offset long, length long")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), *([pa.int64(), pa.string(), pa.string(), pa.int64()] if read else [pa.string(), pa.int64(), pa.int64()])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        slices: dict[int, list[tuple]] = {}
        for batch in batches:
            for key, ts, page_id, number, path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                slices.setdefault(number, []).append((key, ts, page_id is not None, page_id or 0, path, offset, length))
        runs, rows = _Runs(), []
        for position, (key, ts, known, page_id, path, offset, length) in enumerate(LoserTree([iter(s) for s in slices.values()])):
            if read:
                found = decode_record(runs.read(path, offset, length))
                rows.append((key, ts, found[0], shard, position, *found[1:]))
            else:
                rows.append((key, ts, page_id if known else None, shard, position, path, offset, length))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return index.repartitionByRange(ranges, "url_key", "ts", "page_id", "run", "offset").sortWithinPartitions("run", "offset").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, then read them back in the order of their capture histories."""
    return merge_histories(materialize(write_runs(plan_records(pages, min_bytes)), "index"))
