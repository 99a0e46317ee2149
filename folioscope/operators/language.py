"""Languages of volumes from predictions for their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import columns


def predict_pages(pages: DataFrame, predict: Callable[[list[str]], list[tuple[str, float]]], text: str = "text") -> DataFrame:
    """All columns and ``label`` and ``conf`` from any model: ``predict`` gets the texts of a batch, line breaks as spaces."""
    schema = T.StructType([*(f for f in pages.schema if f.name not in ("label", "conf")), T.StructField("label", T.StringType()), T.StructField("conf", T.DoubleType())])
    kept = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict([t or "" for t in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema.names)

    return pages.select(*kept, F.translate(text, "\n", " ").alias("__line")).mapInArrow(run, schema)


def majority(pages: DataFrame, min_conf: float = 0.5, min_chars: int = 100, order: str = "row_ord") -> DataFrame:
    """(volume, language): the commonest code of confident pages, ties to the first seen, else ``und``."""
    code = columns.short_code(F.col("label"))
    sure = pages.withColumn("code", code).where((F.col("conf") >= min_conf) & (F.col("code") != "und") & (F.length("text") >= min_chars))
    votes = sure.groupBy("volume", "code").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("volume").orderBy(F.desc("n"), "first"))).where("r = 1")
    return pages.select("volume").distinct().join(best.select("volume", "code"), "volume", "left").select("volume", F.coalesce("code", F.lit("und")).alias("language"))


def label_pages(pages: DataFrame, **options) -> DataFrame:
    """Each page with its own prediction and its volume's language."""
    return pages.join(majority(pages, **options).withColumnRenamed("language", "language_volume"), "volume").withColumn("language", F.col("language_volume"))


def restamp(rows: DataFrame, labels: DataFrame, key: str = "page_id") -> DataFrame:
    """Only ``language`` changes, and only where ``labels`` has a value for the page."""
    new = labels.select(key, F.col("language").alias("__new"))
    return rows.join(new, key, "left").withColumn("language", F.coalesce("__new", "language")).drop("__new").select(rows.columns)


def restamped(before: DataFrame, after: DataFrame, key: str = "page_id") -> int:
    """How many pages changed."""
    return before.select(key, F.col("language").alias("a")).join(after.select(key, F.col("language").alias("b")), key).where(~F.col("a").eqNullSafe(F.col("b"))).count()
