"""Fail-closed checks of scorecards and joins.

Every check is a column (row checks) or a small aggregate (table checks).  ``violations``
returns them as rows (check, row, message); ``require`` raises the first by row, then by
the order of the checks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns
from folioscope.operators import report

REQUIRED = ("model", "page_id", "volume", "error", "sample_stratum", "sample_stratum_threshold", "score_provenance", "norm_version", "scorer_version", "scorecard_schema_version")


def _close(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | (F.coalesce(F.abs(a - b) <= 1e-9, F.lit(False)))


def _counted(name: str, rows: DataFrame) -> Column:
    kind = dict(rows.dtypes)[name]
    value = F.col(name)
    whole = F.lit(True) if kind in ("bigint", "int") else ~F.isnan(value) & (value == F.floor(value))
    return F.coalesce(whole & (value >= 0), F.lit(False))


def row_checks(rows: DataFrame) -> list[tuple[str, Column, str]]:
    """(name, column that is true for good rows, message)."""
    blank = lambda c: F.coalesce(columns.strip(F.col(c).cast("string")) != "", F.lit(False))
    checks = [
        ("model", blank("model"), "no model"),
        ("page_id", blank("page_id"), "no page id"),
        ("volume", blank("volume"), "no volume"),
        ("error", F.col("error").isNotNull(), "error is not a boolean"),
        ("stratum", F.coalesce(F.col("sample_stratum").isin(*C.STRATA), F.lit(False)), "unknown stratum"),
        ("threshold", F.coalesce(F.col("sample_stratum_threshold") >= 0, F.lit(False)), "bad stratum threshold"),
    ]
    for k in C.COUNT_KEYS:
        checks.append((f"counts {k}", _and(*(_counted(f"{k}_{x}", rows) for x in "sdih")), f"{k} counts are not whole numbers of at least 0"))
    for (a, b), axis in zip(C.SUPPORT_PAIRS, ("recall", "over_extraction", "furniture_global_token_recall"), strict=True):
        checks.append((f"support {axis}", _counted(a, rows) & _counted(b, rows) & F.coalesce(F.col(a) <= F.col(b), F.lit(False)), f"{a} exceeds {b}"))
        empty = F.lit(0.0) if axis == "over_extraction" else F.lit(None).cast("double")
        checks.append((f"rate {axis}", _close(F.col(axis), F.coalesce(columns.rate(F.col(a), F.col(b)), empty)), f"{axis} is not its supports' rate"))
    for axis, k in (("cer_diplomatic", "cer_body_dip"), ("cer_reading", "cer_body_read")):
        checks.append((f"rate {axis}", _close(F.col(axis), report.pooled_rate(k)), f"{axis} is not its counts' rate"))
    checks.append(("script_match", F.coalesce(F.col("script_match").between(0, 1), F.lit(True)), "script_match is outside 0 to 1"))
    regions = F.from_json("region_global_token_recall", report._REGION)
    good = F.forall(F.map_values(regions), lambda r: F.coalesce((r["matched"] >= 0) & (r["reference"] > 0) & (r["matched"] <= r["reference"]) & (F.abs(r["rate"] - r["matched"] / r["reference"]) <= 5.1e-5), F.lit(False)))
    checks.append(("regions", F.coalesce(good, F.lit(False)), "bad region recall"))
    for name, value in (("norm_version", C.NORM_VERSION), ("scorer_version", C.SCORER_VERSION), ("scorecard_schema_version", C.SCORECARD_SCHEMA_VERSION)):
        checks.append((name, F.coalesce(F.col(name) == value, F.lit(False)), f"{name} is not {value}"))
    fields = [F.get_json_object("score_provenance", f"$.{f}").isNotNull() for f in C.SCORE_FIELDS]
    checks.append(("score_provenance", F.coalesce(_and(*fields), F.lit(False)), "score provenance is incomplete"))
    if "run_provenance" in rows.columns:
        checks.append(("run_provenance", F.coalesce(~F.col("run_provenance").isin("", "{}", "null"), F.lit(False)), "no run provenance"))
    return checks


def _and(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def violations(rows: DataFrame) -> DataFrame:
    """(rank, check, model, page_id, message) of all failed row checks, in one pass."""
    failed = [F.when(~good, F.struct(F.lit(i).alias("rank"), F.lit(name).alias("check"), F.lit(message).alias("message"))) for i, (name, good, message) in enumerate(row_checks(rows))]
    found = rows.select("model", "page_id", F.explode(F.filter(F.array(*failed), lambda v: v.isNotNull())).alias("v"))
    return found.select("v.rank", "v.check", "model", "page_id", "v.message")


def table_violations(rows: DataFrame) -> DataFrame:
    """(rank, check, model, page_id, message) of groups that contradict each other."""
    out = []

    def add(check: str, found: DataFrame, message: str, model: Column | None = None, page: Column | None = None) -> None:
        none = F.lit(None).cast("string")
        out.append(found.select(F.lit(100 + len(out)).alias("rank"), F.lit(check).alias("check"), (none if model is None else model.cast("string")).alias("model"), (none if page is None else page.cast("string")).alias("page_id"), F.lit(message).alias("message")))

    add("duplicate", repeated(rows, ["model", "page_id"]), "a page twice for a model", F.col("model"), F.col("page_id"))
    for name in [c for c in ("norm_version", "scorer_version", "scorecard_schema_version", "postproc_version", "score_provenance", "benchmark_provenance") if c in rows.columns]:
        add(f"mixed {name}", rows.agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b"), f"{name} differs between rows")
    if "run_provenance" in rows.columns:
        add("mixed run", rows.groupBy("model").agg(F.min("run_provenance").alias("a"), F.max("run_provenance").alias("b")).where("a <> b"), "one model, several runs", F.col("model"))
    add("stratum conflict", rows.groupBy("page_id").agg(F.min("sample_stratum").alias("a"), F.max("sample_stratum").alias("b")).where("a <> b"), "a page in two strata", None, F.col("page_id"))
    add("threshold", rows.agg(F.min("sample_stratum_threshold").alias("a"), F.max("sample_stratum_threshold").alias("b")).where("a <> b"), "stratum thresholds differ")
    sets = rows.groupBy("model").agg(F.count_distinct("page_id").alias("n"), F.sum(F.xxhash64("page_id").cast("decimal(38,0)")).alias("h"))
    add("page sets", sets.agg(F.count_distinct("n", "h").alias("k")).where("k > 1"), "models cover different pages")
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def _whole(value: object, least: int | None = 0) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and (least is None or value >= least)


def _text(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def check_sampler(sampler: object, threshold: int) -> None:
    """All fields of a sampler's provenance, and nothing else, each of its type."""
    if not isinstance(sampler, dict) or set(sampler) != {*C.SAMPLER_FIELDS, "sample_stratum_threshold"}:
        raise ValueError("sampler provenance has missing or unknown fields")
    good = {"sampler_seed": lambda v: _whole(v, None), "sampler_requested_n": _whole}
    for field in C.SAMPLER_FIELDS:
        if not good.get(field, _text)(sampler[field]):
            raise ValueError(f"bad {field} in the sampler provenance")
    if sampler["sample_stratum_threshold"] != threshold:
        raise ValueError("sampler and benchmark have different stratum thresholds")


def check_benchmark(benchmark: dict) -> None:
    missing = [f for f in C.BENCHMARK_FIELDS if f not in benchmark]
    if missing:
        raise ValueError(f"benchmark provenance lacks {', '.join(missing)}")
    count, strata, threshold = (benchmark[f] for f in ("expected_page_count", "expected_stratum_counts", "sample_stratum_threshold"))
    if not _whole(count, 1):
        raise ValueError("expected_page_count must be a whole number above 0")
    if not _whole(threshold):
        raise ValueError("sample_stratum_threshold must be a whole number of at least 0")
    if not isinstance(strata, dict) or set(strata) != set(C.STRATA) or not all(map(_whole, strata.values())) or sum(strata.values()) != count:
        raise ValueError("expected_stratum_counts must give every stratum and add up to the page count")
    for field in ("dataset_id", "resolved_revision", "dataset_fingerprint", "full_page_set_fingerprint"):
        if not _text(benchmark[field]):
            raise ValueError(f"{field} must not be empty")
    if benchmark["requested_revision"] is not None and not _text(benchmark["requested_revision"]):
        raise ValueError("requested_revision must be null or not empty")
    if benchmark.get("sampler_provenance") is not None:
        check_sampler(benchmark["sampler_provenance"], threshold)


def benchmark_violations(rows: DataFrame, benchmark: dict, expected: DataFrame | None = None) -> DataFrame:
    """(rank, check, model, page_id, message) of models that differ from the benchmark.

    Counts per model and stratum are compared with the expected ones.  With ``expected``
    (page_id) the page sets are compared by anti-joins; without it, by their fingerprints.
    """
    n, strata = benchmark["expected_page_count"], benchmark["expected_stratum_counts"]
    none = F.lit(None).cast("string")
    found = []

    def add(check: str, df: DataFrame, message: Column, page: Column = none) -> None:
        found.append(df.select(F.lit(200 + len(found)).alias("rank"), F.lit(check).alias("check"), F.col("model").cast("string").alias("model"), page.alias("page_id"), message.alias("message")))

    add("benchmark threshold", rows.where(~F.col("sample_stratum_threshold").eqNullSafe(F.lit(benchmark["sample_stratum_threshold"]))), F.lit("the row's threshold is not the benchmark's"), F.col("page_id").cast("string"))
    sums = rows.groupBy("model").agg(F.count("*").alias("n"), *(F.count_if(F.col("sample_stratum") == s).alias(s) for s in C.STRATA))
    over, other = F.lit(False), F.lit(False)
    for s in C.STRATA:
        over, other = over | (F.col(s) > strata[s]), other | (F.col(s) != strata[s])
    add("stratum counts", sums.where(over | ((F.col("n") == n) & other)), F.lit("stratum counts are not the benchmark's"))
    if expected is not None:
        wanted = expected.select(F.col("page_id").alias("page_key"))
        add("missing pages", report.missing_pages(rows, wanted), F.concat(F.lit("lacks "), F.col("missing").cast("string"), F.lit(" pages, e.g. "), F.array_join("examples", ", ")))
        add("extra pages", report.extra_pages(rows, wanted), F.concat(F.lit("has "), F.col("extra").cast("string"), F.lit(" pages that are not expected")))
    else:
        prints = columns.group_fingerprints(rows, "model", "page_id").join(sums.select("model", "n"), "model")
        add("page set", prints.where((F.col("n") != n) | (F.col("fingerprint") != benchmark["full_page_set_fingerprint"])), F.concat(F.lit("has "), F.col("n").cast("string"), F.lit(f" pages instead of the benchmark's {n}, or others")))
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


def check_expected(expected: DataFrame, benchmark: dict) -> None:
    """Explicit expected ids: known, unique, and the benchmark's."""
    if not expected.where("page_id is null").isEmpty():
        raise ValueError("an expected page id is null")
    if not repeated(expected, ["page_id"]).isEmpty():
        raise ValueError("an expected page id occurs twice")
    if expected.count() != benchmark["expected_page_count"] or columns.page_set_fingerprint(expected, "page_id") != benchmark["full_page_set_fingerprint"]:
        raise ValueError("the expected page ids are not the benchmark's")


def require(rows: DataFrame, require_complete: bool = True, expected: DataFrame | None = None) -> None:
    """Raise the first violation: row checks, then table checks, then those against the benchmark.

    The benchmark is what ``benchmark_provenance`` of the rows says (checked to be one value);
    rows without that column are compared with each other only.
    """
    if rows.isEmpty():
        raise ValueError("there are no scorecards")
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"scorecards lack {', '.join(missing)}")
    complete = {"page sets", "page set", "missing pages", "extra pages"}

    def refuse(found: DataFrame) -> None:
        if not require_complete:
            found = found.where(~F.col("check").isin(*complete))
        first = found.orderBy("model", "page_id", "rank").first()
        if first:
            raise ValueError(f"{first['message']} (model {first['model']}, page {first['page_id']})")

    refuse(violations(rows))
    refuse(table_violations(rows))
    if "benchmark_provenance" in rows.columns:
        benchmark = json.loads(rows.select("benchmark_provenance").first()[0] or "{}")
        check_benchmark(benchmark)
        if expected is not None:
            check_expected(expected, benchmark)
        refuse(benchmark_violations(rows, benchmark, expected))


def check_join(outputs: DataFrame, truth: DataFrame) -> None:
    """What the strict join presupposes: unique known keys on both sides, no foreign page, texts that are strings."""
    for side, keys in ((truth, ["page_key"]), (outputs, ["model", "page_key"])):
        if not side.where(" or ".join(f"{k} is null" for k in keys)).isEmpty():
            raise ValueError("null " + " or ".join(keys))
        twice = repeated(side, keys).select(*keys).limit(3).collect()
        if twice:
            raise ValueError(f"repeated {', '.join(keys)}: {[tuple(r) for r in twice]}")
    foreign = [r[0] for r in outputs.join(truth, "page_key", "left_anti").select("page_key").distinct().orderBy("page_key").limit(3).collect()]
    if foreign:
        raise ValueError(f"pages that the ground truth does not have: {foreign}")
    if not outputs.where("text is null").isEmpty():
        raise ValueError("an output text is null")


def first_by_row(found: DataFrame, order: str = "row_ord") -> DataFrame:
    """The first violation of each row."""
    return found.withColumn("r", F.row_number().over(Window.partitionBy(order).orderBy("rank"))).where("r = 1").drop("r")
