"""Fixed-size count tables over a whole table, and connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._common import materialize

#: Counters of a table: what is broadcast has this size at every input size.
SLOTS = 1 << 20
_CHUNK = 1 << 15


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def parts_of(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A task's counts as compressed rows (part, data)."""
    parts = [p for p in range(0, SLOTS // _CHUNK) if counts[p * _CHUNK : (p + 1) * _CHUNK].any()]
    return parts, [zlib.compress(counts[p * _CHUNK : (p + 1) * _CHUNK].astype("<u4").tobytes(), 1) for p in parts]


def sum_parts(df: DataFrame) -> np.ndarray:
    """Add up rows (part, data) on the executors, holding one table at most in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zlib.decompress(data.as_buffer()), "<u4").astype(np.uint64)
                total[part] = total[part] + counts if part in total else counts
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "data": pa.array([zlib.compress(np.minimum(t, 0xFFFFFFFF).astype("<u4").tobytes(), 1) for t in total.values()], pa.binary())})

    out = np.zeros(SLOTS, np.uint32)
    for part, data in df.select("part", "data").repartition("part").mapInArrow(run, "part int, data binary").collect():
        out[part * _CHUNK : (part + 1) * _CHUNK] = np.frombuffer(zlib.decompress(data), "<u4")
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v), u > v."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


#: Links that one task joins up by itself (32 MB); more go through distributed rounds.
ONE_TASK_LINKS = 2_000_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of links: roots hook onto lesser roots until none is left."""
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]
    for x in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x : x + 50_000]), pa.array(nodes[root[x : x + 50_000]])], ["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each component, for all nodes with a link.

    Up to ``ONE_TASK_LINKS`` links are joined up in one task.  More take large-star and
    small-star steps in turn until nothing changes; each round is written to the shared
    folder, and only two numbers of it reach the driver.
    """
    links = materialize(links.select("u", "v"), "links")
    if links.count() <= ONE_TASK_LINKS:
        return links.coalesce(1).mapInArrow(_join_up, "node long, component long")
    return star_components(links)


def star_components(links: DataFrame) -> DataFrame:
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        edges = materialize(_star(_star(edges, True), False), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
