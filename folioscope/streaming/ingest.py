"""Part files as a stream, and a bounded map over an outside service.

Sealing and transforms work row by row and append; which row of a page counts is decided
in batch over what has arrived, since a later success replaces an earlier error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.operators import consolidate
from folioscope.sources import sinks

PART = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "raw", "error", "finish_reason", "model")])
ATTEMPTS = 3


def stream_parts(spark: SparkSession, folder: str, schema: T.StructType = PART, files_per_trigger: int = 100) -> DataFrame:
    """Sealed rows of part files as they arrive."""
    parts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return consolidate.seal(parts.withColumnRenamed("id", "page_id")).withColumn("arrived", F.current_timestamp())


def append_parts(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: T.StructType = PART) -> None:
    """Bring ``target`` up to date with ``folder``: each file once, whatever fails in between."""
    query = stream_parts(spark, folder, schema).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The row of each page that counts: its success, else its first error."""
    rows = spark.read.parquet(target)
    return consolidate.latest(rows.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw_verbatim"))), order="arrived")


def answer(request: Callable[[str], tuple[str | None, str]], prompt: str) -> tuple[str, str | None]:
    """(raw, error): up to three attempts; a cut-off or missing answer becomes a note, an empty one is text."""
    for attempt in range(ATTEMPTS):
        try:
            text, reason = request(prompt)
        except Exception as e:  # the service's own errors, whatever they are
            if attempt == ATTEMPTS - 1:
                return f"{C.ERROR_PREFIX}{type(e).__name__}", str(e)
            continue
        if text is None:
            return f"{C.ERROR_PREFIX}EmptyContent", "no content"
        return (text, None) if reason == "stop" else (f"{C.TRUNCATED_PREFIX}:{reason}", None)
    raise AssertionError("unreachable")


class AdaptiveWindow:
    """How many calls may be under way: grows by ``step`` while fewer than ``target`` calls wait at
    the service, shrinks by ``step`` while more do; between 1 and ``most``.

    ``waiting`` asks the service how many calls wait; without it the window stays as it began.
    """

    def __init__(self, initial: int, target: int, most: int, step: int = 1, waiting: Callable[[], int] | None = None) -> None:
        if not 1 <= initial <= most or step < 1 or target < 0:
            raise ValueError("the window must begin between 1 and its limit, and change by 1 at least")
        self.size, self.target, self.most, self.step, self.waiting = initial, target, most, step, waiting

    def after_answer(self) -> int:
        if self.waiting is not None:
            queued = self.waiting()
            if queued < self.target:
                self.size = min(self.most, self.size + self.step)
            elif queued > self.target:
                self.size = max(1, self.size - self.step)
        return self.size


def ordered_window(function: Callable, items: Iterator, workers: int, window: AdaptiveWindow | None = None) -> Iterator:
    """Map with a window of calls under way (twice ``workers`` without one), results in order, items read lazily."""
    window = window or AdaptiveWindow(2 * workers, 0, 2 * workers)
    with ThreadPoolExecutor(workers) as pool:
        waiting = deque(pool.submit(function, x) for x in islice(items, window.size))
        try:
            while waiting:
                yield waiting.popleft().result()
                room = window.after_answer() - len(waiting)
                waiting.extend(pool.submit(function, x) for x in islice(items, max(0, room)))
        finally:
            for call in waiting:  # an error or an interrupt: what has not begun never does
                call.cancel()


def map_service(rows: DataFrame, request: Callable[[str], tuple[str | None, str]], key: str = "page_id", prompt: str = "prompt", workers: int = 8, window: Callable[[], AdaptiveWindow] | None = None) -> DataFrame:
    """(key, raw, error) from an outside service, a bounded number of calls per task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [*ordered_window(lambda p: answer(request, p), iter(batch[prompt]), workers, window() if window else None)]
            yield pd.DataFrame({key: batch[key], "raw": [f[0] for f in found], "error": [f[1] for f in found]})

    return rows.select(F.col(key).cast("string"), prompt).mapInPandas(run, f"{key} string, raw string, error string")


def resume(pages: DataFrame, request: Callable[[str], tuple[str | None, str]], cache: str, retry_errors: bool = True, slices: int = 8, workers: int = 8) -> DataFrame:
    """Ask the service for every page that ``cache`` has no answer for, and return all answers.

    ``pages`` has page_id (unique) and prompt.  Answers are appended slice by slice, so an interrupt
    or an error loses at most the slice under way; errors in the cache are asked again on request.
    """
    spark = pages.sparkSession
    if not pages.where("page_id is null").isEmpty() or not pages.groupBy("page_id").count().where("count > 1").isEmpty():
        raise ValueError("page ids must be known and unique")
    schema = "page_id string, raw string, error string, attempt int"

    def known() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(cache)
        except AnalysisException:  # nothing has been written yet
            return spark.createDataFrame([], schema)

    before = known()
    if not before.join(pages, "page_id", "left_anti").isEmpty():
        raise ValueError("the cache has pages that are not asked for")
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    todo = consolidate.pending(pages, before, retry_errors=retry_errors)
    for k in range(slices):
        # Slices are disjoint, so what was answered meanwhile is not asked for again.
        part = todo.where(F.pmod(F.xxhash64("page_id"), F.lit(slices)) == k)
        map_service(part, request, workers=workers).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(cache)
    answers = consolidate.latest(known().withColumn("order", -F.col("attempt")), order="order").select("page_id", "raw", "error")
    if answers.count() != pages.count():
        raise ValueError("some pages have no answer")
    return answers


def write_ranked_parts(rows: DataFrame, folder: str, every: int, first: int = 0) -> DataFrame:
    """Files ``part-r<rank>-<index>.parquet`` of at most ``every`` rows; a rank is a task.

    Returns (path, rows).  Names do not depend on attempts and a file appears under its name once
    it is whole, so a task that runs again replaces its files by equal ones.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, index, held, size = TaskContext.get().partitionId(), first, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal index, held, size
            path = f"{folder.rstrip('/')}/{sinks.part_name(rank, index)}"
            sinks.write_parquet(pa.Table.from_batches(held), path)
            made = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "rows"])
            index, held, size = index + 1, [], 0
            return made

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, every - size)
                held.append(part)
                size += part.num_rows
                at += part.num_rows
                if size == every:
                    yield flush()
        if held:
            yield flush()

    return rows.select(*names).mapInArrow(run, "path string, rows long")


def with_volume_parameter(pages: DataFrame, wanted: dict[str, str], installed: set[str], default: str, strict: bool = True, name: str = "parameter") -> DataFrame:
    """Each page with its volume's parameter (several joined by ``+``); one whose parts are not installed aborts, or becomes the default."""
    for volume in [r[0] for r in pages.select("volume").distinct().orderBy("volume").toLocalIterator()]:
        parts = wanted.get(volume, default).split("+")
        if strict and (missing := sorted(set(parts) - installed)):
            raise ValueError(f"{'+'.join(missing)} is not installed, which volume {volume} needs")
    usable = {v: p for v, p in wanted.items() if set(p.split("+")) <= installed}
    table = pages.sparkSession.createDataFrame(sorted(usable.items()) or [(None, None)], "volume string, __p string")
    # The table is as large as the mapping that was given.
    return pages.join(F.broadcast(table), "volume", "left").withColumn(name, F.coalesce("__p", F.lit(default))).drop("__p")
