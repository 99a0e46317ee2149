"""Guards of a re-score: what must not have changed between two versions of scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import lanes

TOLERANCE = 1e-12


def has_table(text: str) -> F.Column:
    """Texts that table regrouping could touch."""
    return F.contains(F.lower(text), F.lit("<table")) | F.contains(F.col(text), F.lit("|"))


def compare(before: DataFrame, after: DataFrame, axis: str = "cer_reading") -> DataFrame:
    """(model, page_id, change): pages whose rate changed."""
    keys = ["model", "page_id"]
    both = before.select(*keys, F.col(axis).alias("a")).join(after.select(*keys, F.col(axis).alias("b")), keys)
    return both.where(~F.col("a").eqNullSafe(F.col("b")) & (F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(1.0)) > TOLERANCE)).select(*keys, (F.col("b") - F.col("a")).alias("change"))


def require_guarded(before: DataFrame, after: DataFrame, texts: DataFrame) -> None:
    """Flags and pages without tables stay as they were.

    ``texts`` has model, page_id, text (the output) and gt_text.
    """
    keys = ["model", "page_id"]
    flags = before.select(*keys, F.struct("error", "truncated").alias("a")).join(after.select(*keys, F.struct("error", "truncated").alias("b")), keys)
    if not flags.where("a <> b").isEmpty():
        raise ValueError("error flags changed")
    plain = texts.where(~has_table("text") & ~has_table("gt_text")).select(*keys)
    if not compare(before, after).join(plain, keys, "left_semi").isEmpty():
        raise ValueError("a page without tables changed")


def summary(changes: DataFrame) -> DataFrame:
    """One row: page rows and pages changed, better, worse."""
    return changes.agg(F.count("*").alias("rows"), F.count_distinct("page_id").alias("pages"), F.count_if(F.col("change") < 0).alias("better"), F.count_if(F.col("change") > 0).alias("worse"))


def accent_effect(pages: DataFrame) -> DataFrame:
    """Per model, the pooled distance in the reading lane and with diacritics folded.

    ``pages`` has model, gt_text, out_text; the first figure is the control.
    """
    folded, plain = lanes.lane_udf("reading_folded"), lanes.lane_udf("reading")
    made = pages.select("model", plain("gt_text").alias("a"), plain("out_text").alias("b"), folded("gt_text").alias("c"), folded("out_text").alias("d"))
    return made.groupBy("model").agg((F.sum(F.levenshtein("a", "b")) / F.sum(F.length("a"))).alias("control"), (F.sum(F.levenshtein("c", "d")) / F.sum(F.length("c"))).alias("folded"))
