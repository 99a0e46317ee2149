"""Part rows of producers to one sealed row per page: retries, errors, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns


def with_key(parts: DataFrame, id_column: str = "id", key: str = "page_id") -> DataFrame:
    """Rename the id column; having both is an error."""
    if id_column == key:
        return parts
    if key in parts.columns:
        raise ValueError(f"both {id_column} and {key} are present")
    return parts.withColumnRenamed(id_column, key)


def _failed() -> Column:
    return F.col("raw").isNull() | F.col("error").isNotNull()


def with_optional(parts: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("error", "finish_reason") if c not in parts.columns}
    return parts.withColumns(missing) if missing else parts


def ambiguous_ids(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """Ids with more than one success: they are refused, not chosen from."""
    return with_optional(parts).groupBy(key).agg(F.sum((~_failed()).cast("long")).alias("successes")).where("successes > 1")


def latest(parts: DataFrame, key: str = "page_id", order: str = "row_ord") -> DataFrame:
    """One row per id: a success supersedes errors, otherwise the first row; original columns."""
    parts = with_optional(parts)
    place = F.row_number().over(Window.partitionBy(key).orderBy(_failed().cast("int"), order))
    return parts.withColumn("__place", place).where("__place = 1").drop("__place")


def seal(rows: DataFrame) -> DataFrame:
    """Error and truncation notes into ``raw``, which is kept in ``raw_verbatim``."""
    rows = with_optional(rows)
    failed = _failed()
    cut = ~failed & F.col("finish_reason").isNotNull() & (F.col("finish_reason") != "stop")
    note = F.when(failed, F.concat(F.lit(C.ERROR_PREFIX + "Producer:"), F.coalesce("error", F.lit("empty response")))).when(cut, F.concat(F.lit(C.TRUNCATED_PREFIX + ":"), "finish_reason")).otherwise(F.col("raw"))
    return rows.withColumns({"raw_verbatim": F.col("raw"), "raw": note})


def consolidate(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """Refuse ambiguous ids, drop superseded rows, seal the rest."""
    doubtful = [str(r[0]) for r in ambiguous_ids(parts, key).select(key).orderBy(key).limit(5).collect()]
    if doubtful:
        raise ValueError(f"more than one success for: {', '.join(doubtful)}")
    return seal(latest(parts, key))


def counts(parts: DataFrame, sealed: DataFrame) -> DataFrame:
    """One row: rows, ok, producer_errors, truncated, truncation_rate, superseded_by_retry, finish_reasons."""
    before = parts.agg(F.count("*").alias("all"))
    cut, bad = columns.is_truncated(F.col("raw")), columns.is_error(F.col("raw"))
    now = sealed.agg(F.count("*").alias("rows"), F.count_if(~bad).alias("ok"), F.count_if(bad & ~cut).alias("producer_errors"), F.count_if(cut).alias("truncated"))
    histogram = sealed.where("finish_reason is not null").groupBy("finish_reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("finish_reason", "n")))).alias("finish_reasons"))
    out = now.join(before).join(histogram)  # three rows of one
    return out.select("rows", "ok", "producer_errors", "truncated", columns.rate(F.col("truncated"), F.col("rows")).alias("truncation_rate"), (F.col("all") - F.col("rows")).alias("superseded_by_retry"), "finish_reasons")


def pending(wanted: DataFrame, parts: DataFrame, key: str = "page_id", retry_errors: bool = False) -> DataFrame:
    """Wanted ids without a durable row; on request, ids with errors only count as without."""
    done = with_optional(parts)
    if retry_errors:
        done = done.where(~_failed())
    return wanted.join(done.select(key).distinct(), key, "left_anti")
