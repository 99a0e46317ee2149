"""From scorecards to one card per model: pooled rates, strata, intervals, order.

All rates pool integer counts; bootstrap replicates reuse per-volume sums, so pages are
read once however many replicates there are.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions import columns


def _clean() -> Column:
    """Rows that are not errors; a missing flag is none."""
    return ~F.coalesce(F.col("error"), F.lit(False))


def count_pool(key: str, where: Column | None = None) -> list[Column]:
    """Sums of s, d, i, h; rows without an ``_s`` count are left out, other missing counts are 0."""
    use = F.col(f"{key}_s").isNotNull() if where is None else F.col(f"{key}_s").isNotNull() & where
    return [F.coalesce(F.sum(F.when(use, F.coalesce(F.col(f"{key}_{x}"), F.lit(0)))), F.lit(0)).cast("long").alias(f"{key}_{x}") for x in "sdih"]


def pooled_rate(key: str) -> Column:
    s, d, i, h = (F.col(f"{key}_{x}") for x in "sdih")
    return columns.rate(s + d + i, s + d + h)


def micro_rate(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, rate): edits over reference characters, each summed first."""
    return rows.groupBy(*by).agg(*count_pool(key)).select(*by, pooled_rate(key).alias("rate"))


def support_sums(pair: tuple[str, str]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in pair]


def support_rate(rows: DataFrame, pair: tuple[str, str], by: list[str], empty: float | None = None) -> DataFrame:
    found = rows.groupBy(*by).agg(*support_sums(pair))
    return found.withColumn("rate", F.coalesce(columns.rate(F.col(pair[0]), F.col(pair[1])), F.lit(empty).cast("double")))


def percentile(values: Column, share: float) -> Column:
    """Linear interpolation at (n - 1) * share."""
    return F.percentile(values, F.lit(share))


def median(axis: str) -> Column:
    return columns.round4(F.median(F.when(~F.isnan(axis), F.col(axis))))


def mean(axis: str) -> Column:
    """Mean of four-decimal values, summed exactly."""
    value = F.when(~F.isnan(axis), F.col(axis)).cast("decimal(18,4)")
    return columns.round4(F.sum(value).cast("double") / F.count(value))


def stratified(rows: DataFrame, key: str, by: str) -> DataFrame:
    """(model, map of ``by`` to rate), sorted by value, nulls left out."""
    found = micro_rate(rows.where(F.col(by).isNotNull()), key, ["model", by])
    return found.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by).alias("key"), F.col("rate").alias("value"))))).alias("rates"))


_REGION = T.MapType(T.StringType(), T.StructType([T.StructField("rate", T.DoubleType()), T.StructField("matched", T.LongType()), T.StructField("reference", T.LongType())]))


def region_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, matched, reference, rate) pooled from the pages' JSON objects."""
    parsed = rows.select(*by, F.explode(F.from_json("region_global_token_recall", _REGION)).alias("label", "r"))
    return parsed.groupBy(*by, "label").agg(F.sum("r.matched").alias("matched"), F.sum("r.reference").alias("reference")).withColumn("rate", columns.rate(F.col("matched"), F.col("reference")))


def bootstrap_draws(units: int, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = 0) -> Iterator[list[int]]:
    """How often each unit is drawn, replicate by replicate; one replicate is held at a time."""
    rng = random.Random(seed)
    for _ in range(replicates):
        weights = [0] * units
        for _ in range(units):
            weights[rng.randrange(units)] += 1
        yield weights


def bootstrap_ci(rows: DataFrame, key: str = "cer_body_read", order: str = "page_id", replicates: int = C.BOOTSTRAP_REPLICATES, alpha: float = C.BOOTSTRAP_ALPHA, seed: int = 0, pools: list[Column] | None = None, statistic: Column | None = None) -> DataFrame:
    """(model, lo, hi): cluster bootstrap over volumes, in order of their first page.

    ``statistic`` is any column over sums named by ``pools`` (sums of rows, with names); without
    them it is the pooled rate of ``key``.  A model with a null volume, or with one only, is
    resampled by page.  Sums are taken per unit first; the draws (replicates x units) are a
    table that each model's units join, so replicates cost one weighted sum per unit.
    """
    pools = count_pool(key) if pools is None else pools
    statistic = pooled_rate(key) if statistic is None else statistic
    clean = rows.where(_clean())
    per_model = clean.groupBy("model").agg(F.count_distinct("volume").alias("v"), F.max(F.col("volume").isNull()).alias("loose"))
    unit = F.when((F.col("v") > 1) & ~F.col("loose"), F.col("volume")).otherwise(F.col(order))
    units = clean.join(F.broadcast(per_model), "model").withColumn("unit", unit.cast("string")).groupBy("model", "unit").agg(F.min(order).alias("first"), *pools)  # a row a model
    names = [c for c in units.columns if c not in ("model", "unit", "first")]
    # Few rows a model: its volumes, or its pages.
    numbered = units.select("*", F.row_number().over(_window("model", "first", "unit")).alias("u"), F.count("*").over(_window("model")).alias("units"))
    sizes = [r["units"] for r in numbered.select("units").distinct().collect()]
    draws = _draw_table(rows.sparkSession, sizes, replicates, seed)
    sums = numbered.join(draws, ["units", "u"]).groupBy("model", "replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in names))
    rates = sums.withColumn("rate", statistic).where("rate is not null")
    return rates.groupBy("model").agg(*(columns.round4(percentile(F.col("rate"), p)).alias(n) for n, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2))))


def _window(part: str, *order: str):
    from pyspark.sql import Window

    w = Window.partitionBy(part)
    return w.orderBy(*order) if order else w


_DRAWS = "units long, u long, replicate long, times long"


def _draw_table(spark, sizes: list[int], replicates: int, seed: int) -> DataFrame:
    """(units, u, replicate, times), drawn on the executors; a task holds one replicate of one unit count."""
    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for units in batch.column(0).to_pylist():
                for r, weights in enumerate(bootstrap_draws(units, replicates, seed)):
                    times = np.array(weights, np.int64)
                    u = np.flatnonzero(times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), units)), pa.array(u + 1), pa.array(np.full(len(u), r)), pa.array(times[u])], ["units", "u", "replicate", "times"])

    table = spark.createDataFrame([(int(s),) for s in sizes], "units long")
    return table.mapInArrow(draw, _DRAWS)


def missing_pages(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, missing, first three ids): expected pages that a model has no row for."""
    models = sorted(r[0] for r in rows.select("model").distinct().collect())  # a few names
    expected = truth.select(F.explode(F.array(*map(F.lit, models)) if models else F.array().cast("array<string>")).alias("model"), F.col("page_key").alias("page_id"))
    gone = expected.join(rows.select("model", "page_id"), ["model", "page_id"], "left_anti")
    # The rank limit is applied before the shuffle too, so a task passes three ids a model on.
    first = gone.withColumn("r", F.row_number().over(_window("model", "page_id"))).where("r <= 3").groupBy("model").agg(F.array_sort(F.collect_list("page_id")).alias("examples"))
    return gone.groupBy("model").agg(F.count("*").alias("missing")).join(first, "model")


def extra_pages(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, extra): rows of pages that are not expected."""
    return rows.join(truth.select(F.col("page_key").alias("page_id")), "page_id", "left_anti").groupBy("model").agg(F.count("*").alias("extra"))


#: What cards are made of; scorecards that are written for them need no more.
CARD_COLUMNS = ["model", "page_id", "volume", "language", "gt_script", "error", "truncated", "sample_stratum", *(f"{k}_{x}" for k in ("cer_body_dip", "cer_body_read") for x in "sdih"), *(c for pair in C.SUPPORT_PAIRS for c in pair), "cer_reading", "script_match", "region_global_token_recall"]


def model_cards(rows: DataFrame, truth: DataFrame | None = None, full_text: bool = False, replicates: int = C.BOOTSTRAP_REPLICATES) -> DataFrame:
    """One row per model with all fields of its card."""
    clean = _clean()
    truncated = F.sum(F.coalesce(F.col("truncated"), F.lit(False)).cast("long"))
    keys = ["cer_body_dip", "cer_body_read"] + (["cer_full_read"] if full_text else [])
    pools = [c for k in keys for c in count_pool(k, clean)]
    supports = [F.coalesce(F.sum(F.when(clean, F.col(c))), F.lit(0)).cast("long").alias(c) for p in C.SUPPORT_PAIRS for c in p]
    medians = [columns.round4(F.median(F.when(clean & ~F.isnan("cer_reading"), F.col("cer_reading")))).alias("cer_reading_median"), columns.round4(F.sum(F.when(clean & ~F.isnan("script_match"), F.col("script_match")).cast("decimal(18,4)")).cast("double") / F.count(F.when(clean & ~F.isnan("script_match"), F.col("script_match")))).alias("script_match")]
    cards = rows.groupBy("model").agg(F.count("*").alias("submitted"), F.sum(clean.cast("long")).alias("n"), F.sum((~clean).cast("long")).alias("errors"), truncated.alias("t"), *pools, *supports, *medians)
    cards = cards.withColumn("truncated", F.least("t", "errors")).drop("t").withColumn("producer_errors", F.col("errors") - F.col("truncated")).withColumn("truncation_rate", F.col("truncated") / F.col("submitted"))
    cards = cards.withColumns({"cer_diplomatic_micro": pooled_rate("cer_body_dip"), "cer_reading_micro": pooled_rate("cer_body_read"), "recall_micro": columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[0])), "over_extraction_micro": F.coalesce(columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[1])), F.lit(0.0)), "furniture_global_token_recall_micro": columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[2]))})
    if full_text:
        cards = cards.withColumn("full_text_cer", pooled_rate("cer_full_read"))
    ok = rows.where(clean)
    for by, name in (("language", "by_language"), ("volume", "by_volume"), ("gt_script", "by_script"), ("sample_stratum", "by_sample_stratum")):
        cards = cards.join(stratified(ok, "cer_body_read", by).withColumnRenamed("rates", name), "model", "left")
    regions = region_recall(ok, ["model"]).groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("rate", "matched", "reference"))))).alias("region_global_token_recall"))
    cards = cards.join(regions, "model", "left").join(bootstrap_ci(rows, replicates=replicates).select("model", F.struct("lo", "hi").alias("cer_ci")), "model", "left")
    if truth is not None:
        cards = cards.join(missing_pages(rows, truth).select("model", "missing"), "model", "left").join(extra_pages(rows, truth), "model", "left")
    else:
        cards = cards.withColumns({"missing": F.lit(0).cast("long"), "extra": F.lit(0).cast("long")})
    cards = cards.withColumns({"missing": F.coalesce("missing", F.lit(0)), "extra": F.coalesce("extra", F.lit(0))})
    return cards.withColumn("benchmark_page_set_match", (F.col("missing") == 0) & (F.col("extra") == 0)).withColumn("eligible", eligible())


def eligible() -> Column:
    return (F.col("producer_errors") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0) & F.col("benchmark_page_set_match") & F.col("cer_diplomatic_micro").isNotNull() & F.col("cer_reading_micro").isNotNull()


def stratum_cards(rows: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """(model, stratum) cards, expected strata without rows included."""
    clean = _clean()
    found = rows.groupBy("model", "sample_stratum").agg(F.count("*").alias("submitted"), F.sum(clean.cast("long")).alias("n"), F.sum((~clean).cast("long")).alias("errors"), *count_pool("cer_body_read", clean), *(F.coalesce(F.sum(F.when(clean, F.col(c))), F.lit(0)).cast("long").alias(c) for p in C.SUPPORT_PAIRS[:2] for c in p))
    if expected:
        strata = rows.select("model").distinct().select("model", F.explode(F.array(*map(F.lit, expected))).alias("sample_stratum"))
        found = strata.unionByName(found.select("model", "sample_stratum")).distinct().join(found, ["model", "sample_stratum"], "left")
    zero = [c for c in found.columns if c not in ("model", "sample_stratum")]
    found = found.fillna(0, zero)
    return found.select("model", "sample_stratum", "submitted", "n", "errors", pooled_rate("cer_body_read").alias("cer_reading_micro"), columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[0])).alias("recall_micro"), *C.SUPPORT_PAIRS[0], F.coalesce(columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[1])), F.lit(0.0)).alias("over_extraction_micro"), *C.SUPPORT_PAIRS[1])


def board_order(cards: DataFrame) -> DataFrame:
    """Cards with ``place`` among the eligible and among the others: by rate, nulls last, then name."""
    from pyspark.sql import Window

    return cards.withColumn("place", F.row_number().over(Window.partitionBy("eligible").orderBy(F.col("cer_reading_micro").asc_nulls_last(), "model")))


def leaderboard(cards: DataFrame, provenance: dict) -> dict:
    """The board's JSON object; one row per model reaches the driver."""
    made = [r.asDict(recursive=True) for r in board_order(cards).orderBy(F.desc("eligible"), "place").collect()]
    names = [m["model"] for m in sorted(made, key=lambda m: (m["cer_reading_micro"] is None, m["cer_reading_micro"] or 0.0, m["model"]))]
    return {"schema_version": C.REPORT_SCHEMA_VERSION, "provenance": provenance, "scorecards": {m["model"]: m for m in made}, "order": names, "eligible_order": [m["model"] for m in made if m["eligible"]], "ineligible_order": [m["model"] for m in made if not m["eligible"]]}


def write_leaderboard(board: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(board, indent=2, default=str) + "\n")


def format_board(board: dict) -> str:
    """A fixed-width text table, the eligible first."""
    show = lambda x: "-" if x is None else f"{x:.4f}"
    out = []
    for title, order in (("eligible", board["eligible_order"]), ("not eligible", board["ineligible_order"])):
        if not order:
            continue
        out.append(f"{title:<40}{'CER':>8}{'95% interval':>20}{'recall':>8}{'extra':>8}{'n':>8}")
        for name in order:
            card = board["scorecards"][name]
            ci = card.get("cer_ci") or {}
            out.append(f"{name:<40}{show(card['cer_reading_micro']):>8}{'[' + show(ci.get('lo')) + ', ' + show(ci.get('hi')) + ']':>20}{show(card['recall_micro']):>8}{show(card['over_extraction_micro']):>8}{card['n']:>8}")
            for field in ("by_volume", "by_sample_stratum"):
                if card.get(field):
                    out.append("    " + field + ": " + ", ".join(f"{k} {show(v)}" for k, v in card[field].items()))
    return "\n".join(out) + f"\nschema {board['schema_version']}\n"
