"""Queries of pooling, cards, validation, sampling and cross-checks over derived scorecards."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns, geometry
from folioscope.operators import crosscheck, language, pagetests, report, sampling, validate
from folioscope.plans import fixtures as X
from folioscope.plans.registry import query
from folioscope.sources import responses
from folioscope.sources.shared import written

_RATE = X.rate_sql("sum(s + d + i)", "sum(s + d + h)")


@query(f"""WITH {X.CARDS_SQL} SELECT model, {_RATE} AS micro, {X.rate_sql('sum(rm)', 'sum(rr)')} AS recall, coalesce({X.rate_sql('sum(oe)', 'sum(oo)')}, 0.0) AS extra,
{X.round4_sql('median(cer)')} AS median, {X.round4_sql('(CAST(sum(CAST(script_match AS DECIMAL(18,4))) AS DOUBLE) / count(script_match))')} AS mean FROM c GROUP BY model""")
def pooled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.cards(spark, sf_dir).withColumn("cer_reading", F.when(F.col("cer_reading").isNull(), F.lit(float("nan"))).otherwise(F.col("cer_reading")))
    # One pass over the lines for all of them.
    sums = rows.groupBy("model").agg(*report.count_pool("cer_body_read"), *report.support_sums(C.SUPPORT_PAIRS[0]), *report.support_sums(C.SUPPORT_PAIRS[1]), report.median("cer_reading").alias("median"), report.mean("script_match").alias("mean"))
    recall, extra = (columns.rate(*(F.col(c) for c in pair)) for pair in C.SUPPORT_PAIRS[:2])
    return sums.select("model", report.pooled_rate("cer_body_read").alias("micro"), recall.alias("recall"), F.coalesce(extra, F.lit(0.0)).alias("extra"), "median", "mean")


@query(f"""WITH {X.CARDS_SQL} SELECT model, 'language' AS by, language AS value, {_RATE} AS rate FROM c WHERE language IS NOT NULL GROUP BY ALL
UNION ALL SELECT model, 'volume', volume, {_RATE} FROM c GROUP BY ALL UNION ALL SELECT model, 'gt_script', gt_script, {_RATE} FROM c GROUP BY ALL""")
def stratified_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = X.cards(spark, sf_dir), None
    for by in ("language", "volume", "gt_script"):
        part = report.stratified(rows, "cer_body_read", by).select("model", F.lit(by).alias("by"), F.explode("rates").alias("value", "rate"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {X.CARDS_SQL} SELECT model, language, {X.round4_sql('(CAST(sum(CAST(script_match AS DECIMAL(18,4))) AS DOUBLE) / count(script_match))')} AS mean FROM c WHERE language IS NOT NULL GROUP BY ALL")
def stratified_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cards(spark, sf_dir).where("language is not null").groupBy("model", "language").agg(report.mean("script_match").alias("mean"))


@query(f"""WITH {X.CARDS_SQL}, s AS (SELECT * FROM (SELECT DISTINCT model FROM c), (VALUES ('content'), ('sparse_blank'), ('unseen')) v(sample_stratum)),
g AS (SELECT model, sample_stratum, count(*) AS submitted, count(*) FILTER (WHERE NOT error) AS n, count(*) FILTER (WHERE error) AS errors,
  {X.rate_sql('sum(s + d + i) FILTER (WHERE NOT error)', 'sum(s + d + h) FILTER (WHERE NOT error)')} AS cer_reading_micro, {X.rate_sql('sum(rm) FILTER (WHERE NOT error)', 'sum(rr) FILTER (WHERE NOT error)')} AS recall_micro, CAST(sum(rm) FILTER (WHERE NOT error) AS BIGINT) AS recall_matched FROM c GROUP BY ALL)
SELECT model, sample_stratum, coalesce(submitted, 0) AS submitted, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, cer_reading_micro, recall_micro, coalesce(recall_matched, 0) AS recall_matched FROM s LEFT JOIN g USING (model, sample_stratum)""")
def stratum_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by stratum; an expected stratum without rows has a card of zeros."""
    return report.stratum_cards(X.cards(spark, sf_dir), [*C.STRATA, "unseen"]).select("model", "sample_stratum", "submitted", "n", "errors", "cer_reading_micro", "recall_micro", "recall_matched")


_CARD_SQL = f"""WITH {X.CARDS_SQL}, t AS (SELECT page_id FROM c WHERE o <> 2 UNION ALL SELECT 'absent-' || volume FROM c GROUP BY volume),
g AS (SELECT model, count(*) AS submitted, count(*) FILTER (WHERE NOT error) AS n, count(*) FILTER (WHERE error) AS errors, least(count(*) FILTER (WHERE truncated), count(*) FILTER (WHERE error)) AS truncated,
  {X.rate_sql('sum(s + d + i) FILTER (WHERE NOT error)', 'sum(s + d + h) FILTER (WHERE NOT error)')} AS cer_reading_micro, {X.rate_sql('sum(rm) FILTER (WHERE NOT error)', 'sum(rr) FILTER (WHERE NOT error)')} AS recall_micro,
  coalesce({X.rate_sql('sum(oe) FILTER (WHERE NOT error)', 'sum(oo) FILTER (WHERE NOT error)')}, 0.0) AS over_extraction_micro, {X.rate_sql('sum(fm) FILTER (WHERE NOT error)', 'sum(fr) FILTER (WHERE NOT error)')} AS furniture_global_token_recall_micro,
  {X.round4_sql('median(cer) FILTER (WHERE NOT error)')} AS cer_reading_median FROM c GROUP BY model),
m AS (SELECT g.model, (SELECT count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.model = g.model AND c.page_id = t.page_id)) AS missing, (SELECT count(*) FROM c WHERE c.model = g.model AND c.o = 2) AS extra FROM g)
SELECT model, submitted, n, errors, truncated, errors - truncated AS producer_errors, truncated / submitted AS truncation_rate, cer_reading_micro, recall_micro, over_extraction_micro, furniture_global_token_recall_micro, cer_reading_median, missing, extra,
  errors = truncated AND missing = 0 AND extra = 0 AS eligible, row_number() OVER (PARTITION BY errors = truncated AND missing = 0 AND extra = 0 ORDER BY cer_reading_micro NULLS LAST, model) AS place FROM g JOIN m USING (model)"""


@query(_CARD_SQL)
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' cards against a page set that lacks some pages and has others."""
    rows = X.cards(spark, sf_dir)
    truth = rows.where("page_id not like '%-2'").select(F.col("page_id").alias("page_key")).unionByName(rows.select(F.concat(F.lit("absent-"), "volume").alias("page_key")).distinct())
    made = report.board_order(report.model_cards(written(rows.select(*report.CARD_COLUMNS), "cards"), truth))
    return made.select("model", "submitted", "n", "errors", "truncated", "producer_errors", "truncation_rate", "cer_reading_micro", "recall_micro", "over_extraction_micro", "furniture_global_token_recall_micro", "cer_reading_median", "missing", "extra", "eligible", F.col("place").cast("long").alias("place"))


def _draws_sql(units: int, replicates: int) -> str:
    """The draws of a seeded generator as rows (replicate, unit, times), made one draw at a time."""
    rng, rows = random.Random(0), []
    for r in range(replicates):
        drawn = [rng.randrange(units) for _ in range(units)]
        rows += [f"({r},{u + 1},{drawn.count(u)})" for u in sorted(set(drawn))]
    return f"(VALUES {', '.join(rows)}) v(r, u, times)"


_BOOTSTRAP_SQL = f"""WITH {X.CARDS_SQL}, v AS (SELECT model, volume, min(page_id) AS first, sum(s) AS s, sum(d) AS d, sum(i) AS i, sum(h) AS h, sum(rm) AS rm, sum(rr) AS rr FROM c WHERE NOT error GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY first, volume) AS u FROM v), d AS (SELECT * FROM {_draws_sql(4, C.BOOTSTRAP_REPLICATES)}),
w AS (SELECT model, r, sum(s * times) AS s, sum(d * times) AS d, sum(i * times) AS i, sum(h * times) AS h, sum(rm * times) AS rm, sum(rr * times) AS rr FROM u JOIN d USING (u) GROUP BY ALL),
x AS (SELECT model, {X.rate_sql('(s + d + i)', '(s + d + h)')} AS cer, {X.rate_sql('rm', 'rr')} AS recall FROM w)
SELECT model, {X.round4_sql('quantile_cont(cer, 0.025)')} AS lo, {X.round4_sql('quantile_cont(cer, 0.975)')} AS hi, {X.round4_sql('quantile_cont(recall, 0.025)')} AS recall_lo, {X.round4_sql('quantile_cont(recall, 0.975)')} AS recall_hi FROM x GROUP BY model"""


@query(_BOOTSTRAP_SQL)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the pooled rate and of another statistic; every model has the same four volumes."""
    needed = ["model", "page_id", "volume", "error", *(f"cer_body_read_{x}" for x in "sdih"), *C.SUPPORT_PAIRS[0]]
    rows = written(X.cards(spark, sf_dir).select(*needed), "cards")
    sums = [F.sum(c).cast("long").alias(c) for c in C.SUPPORT_PAIRS[0]]
    recall = report.bootstrap_ci(rows, pools=sums, statistic=columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[0])))
    return report.bootstrap_ci(rows).join(recall.select("model", F.col("lo").alias("recall_lo"), F.col("hi").alias("recall_hi")), "model")


@query(f"WITH {X.CARDS_SQL} SELECT count(DISTINCT model) AS models, count(*) AS rows FROM c")
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cards(spark, sf_dir).agg(F.count_distinct("model").alias("models"), F.count("*").alias("rows"))


@query("SELECT CASE WHEN event_type = 'click' THEN 'error' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    return responses.status_counts(events.select(F.when(F.col("event_type") == "click", F.concat(F.lit("error: "), F.col("user_id").cast("string"))).otherwise(F.col("event_type")).alias("status")))


# -- validation: faults are planted into valid rows ----------------------------------



def _faulty(rows: DataFrame) -> DataFrame:
    k, o = F.split_part("page_id", F.lit("-"), F.lit(1)).cast("long"), F.split_part("page_id", F.lit("-"), F.lit(2)).cast("long")
    rows = rows.withColumns({"k": k, "o": o})
    change = lambda name, when, value: F.when(F.expr(when), value).otherwise(F.col(name)).alias(name)
    new = {
        "volume": ("k % 200 = 3", F.lit(" ")),
        "sample_stratum": ("k % 200 = 4", F.lit("odd")),
        "cer_full_dip_d": ("k % 200 = 5", F.lit(-1).cast("long")),
        "recall_matched": ("k % 200 = 6", F.col("recall_reference") + 1),
        "cer_diplomatic": ("k % 200 = 8 and cer_diplomatic is not null", F.col("cer_diplomatic") + 0.5),
        "script_match": ("k % 200 = 9", F.lit(1.5)),
        "region_global_token_recall": ("k % 200 = 10", F.lit('{"body":{"rate":0.5,"matched":3,"reference":2}}')),
        "scorer_version": ("k % 200 = 11", F.lit("0")),
        "score_provenance": ("k % 200 = 12", F.lit("{}")),
        "run_provenance": ("k % 200 = 13", F.lit("{}")),
        "sample_stratum_threshold": ("k % 200 = 14", F.lit(-1)),
    }
    return rows.select(*(change(c, *new[c]) if c in new else F.col(c) for c in rows.columns if c not in ("k", "o")))


_FOUND = [("volume", "k % 200 = 3"), ("stratum", "k % 200 = 4"), ("counts cer_full_dip", "k % 200 = 5"), ("support recall", "k % 200 = 6"), ("rate recall", "k % 200 = 6"), ("rate cer_diplomatic", "k % 200 = 8 AND cer IS NOT NULL"), ("script_match", "k % 200 = 9"), ("regions", "k % 200 = 10"), ("scorer_version", "k % 200 = 11"), ("score_provenance", "k % 200 = 12"), ("run_provenance", "k % 200 = 13"), ("threshold", "k % 200 = 14")]


@query(f"WITH {X.CARDS_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS check, model, page_id FROM c WHERE {when}" for name, when in _FOUND))
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(_faulty(X.cards(spark, sf_dir))).select("check", "model", "page_id")


@query(f"""WITH {X.CARDS_SQL} SELECT 'duplicate' AS check, model, page_id FROM c WHERE k % 300 = 1 UNION ALL SELECT 'mixed postproc_version', NULL, NULL UNION ALL SELECT 'mixed run', model, NULL FROM c WHERE k % 300 = 2 GROUP BY model
UNION ALL SELECT 'stratum conflict', NULL, page_id FROM c WHERE k % 300 = 3 UNION ALL SELECT 'threshold', NULL, NULL UNION ALL SELECT 'page sets', NULL, NULL""")
def table_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows, mixed versions and runs, pages in two strata, models with different pages."""
    rows = X.cards(spark, sf_dir)
    k = F.split_part("page_id", F.lit("-"), F.lit(1)).cast("long")
    rows = rows.withColumns({"postproc_version": F.when(k % 300 == 4, "9").otherwise(F.col("postproc_version")), "run_provenance": F.when(k % 300 == 2, "{}").otherwise(F.col("run_provenance")), "sample_stratum_threshold": F.when(k % 300 == 5, 1).otherwise(F.col("sample_stratum_threshold"))})
    twice = rows.where(k % 300 == 1)
    other = rows.where(k % 300 == 3).withColumns({"model": F.concat("model", F.lit("+")), "sample_stratum": F.lit("odd")})
    return validate.table_violations(rows.unionByName(twice).unionByName(other)).select("check", "model", "page_id")


@query(f"""WITH {X.CARDS_SQL}, e AS (SELECT count(*) AS n, count(*) FILTER (WHERE sample_stratum = 'content') AS a FROM c WHERE model = 'A'),
g AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE sample_stratum = 'content') AS a FROM c GROUP BY model)
SELECT 'stratum counts' AS check, model, NULL AS page_id FROM g, e WHERE g.a > e.a OR g.n - g.a > e.n - e.a OR (g.n = e.n AND g.a <> e.a)
UNION ALL SELECT 'missing pages', model, NULL FROM g WHERE model <> 'A' UNION ALL SELECT 'extra pages', model, NULL FROM g WHERE model <> 'A'
UNION ALL SELECT 'benchmark threshold', model, page_id FROM c WHERE k % 300 = 5""")
def benchmark_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one model are the benchmark; the others have different ones."""
    rows = X.cards(spark, sf_dir)
    mine = rows.where("model = 'A'")
    found = mine.agg(F.count("*").alias("n"), F.count_if(F.col("sample_stratum") == "content").alias("a")).first()
    benchmark = {"expected_page_count": found["n"], "expected_stratum_counts": {"content": found["a"], "sparse_blank": found["n"] - found["a"]}, "sample_stratum_threshold": C.STRATUM_THRESHOLD}
    k = F.split_part("page_id", F.lit("-"), F.lit(1)).cast("long")
    odd = rows.withColumn("sample_stratum_threshold", F.when(k % 300 == 5, 1).otherwise(F.col("sample_stratum_threshold")))
    return validate.benchmark_violations(odd, benchmark, mine.select("page_id")).select("check", "model", "page_id")


@query(f"WITH {X.CARDS_SQL}, t AS (SELECT model, sha256(CAST(to_json(list_sort(list(page_id))) AS VARCHAR)) AS f, count(*) AS n FROM c GROUP BY model) SELECT model, n FROM t WHERE f <> (SELECT f FROM t WHERE model = 'A')")
def page_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the ids: by fingerprints of the page sets."""
    rows = X.cards(spark, sf_dir)
    mine = rows.where("model = 'A'")
    benchmark = {"expected_page_count": mine.count(), "expected_stratum_counts": dict.fromkeys(C.STRATA, 1 << 60), "sample_stratum_threshold": C.STRATUM_THRESHOLD, "full_page_set_fingerprint": columns.page_set_fingerprint(mine, "page_id")}
    found = validate.benchmark_violations(rows, benchmark).where(F.col("check") == "page set")
    return found.join(rows.groupBy("model").agg(F.count("*").alias("n")), "model").select("model", "n")


# -- sampling, orders, cross-checks ---------------------------------------------------

_SAMPLE_SQL = """WITH s AS (SELECT CASE WHEN length(text) >= 400 THEN 'content' ELSE 'sparse_blank' END AS sample_stratum, count(*) AS c FROM documents GROUP BY ALL),
e AS (SELECT *, sum(c) OVER () AS t, 100 * c // sum(c) OVER () AS q, 100 * c % sum(c) OVER () AS r FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY r DESC, sample_stratum) AS place, 100 - sum(q) OVER () AS rest FROM e)
SELECT sample_stratum, CAST(CASE WHEN t <= 100 THEN c ELSE q + CASE WHEN place <= rest THEN 1 ELSE 0 END END AS BIGINT) AS n FROM p"""


@query(_SAMPLE_SQL)
def sample_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of each stratum a sample of a hundred has."""
    pages = X.truth(spark, sf_dir).withColumn("sample_stratum", columns.stratum(F.col("text"), 400))
    return sampling.volume_spread_sample(pages, 100, 1).groupBy("sample_stratum").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('7/' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 50")
def shuffled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty pages of a seeded order."""
    return sampling.shuffled(X.truth(spark, sf_dir), 7).limit(50).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.truth(spark, sf_dir).orderBy("doc_id").limit(20).select("doc_id")


_E = "len(regexp_extract_all(text, 'e'))"
_AGREEMENT_SQL = f"a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 OR length(text) = 0 THEN NULL ELSE {X.round4_sql(f'(1.0::DOUBLE - {X.rate_sql(_E, 'length(text)')})')} END AS agreement FROM documents)"


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of the pages, of which the second has lost letters and some pages."""
    d = X.table(spark, sf_dir, "documents")
    left = d.select("doc_id", F.concat(F.lit("dir/sub/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("xml_path"), "text")
    right = d.where("doc_id % 10 <> 9").select(F.col("doc_id").cast("string").alias("gt_page_id"), F.replace("text", F.lit("e"), F.lit("")).alias("text"))
    joined = crosscheck.match(left, right)
    return joined.select("doc_id", F.col("gt_page_id").alias("page_key"), F.when(F.col("other_text").isNotNull(), crosscheck.agreement(F.col("text"), F.col("other_text"), in_jvm=False)).alias("agreement"))


@query(f"WITH {_AGREEMENT_SQL} SELECT doc_id, agreement FROM a")
def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _agreement(spark, sf_dir).select("doc_id", "agreement")


@query(f"""WITH {_AGREEMENT_SQL}, r AS (SELECT agreement, row_number() OVER (ORDER BY agreement) - 1 AS k, count(*) OVER () AS n FROM a WHERE agreement IS NOT NULL)
SELECT count(*) AS n, {X.round4_sql('median(agreement)')} AS median, {X.round4_sql('(CAST(sum(CAST(agreement AS DECIMAL(18,4))) AS DOUBLE) / count(*))')} AS mean, count(*) FILTER (WHERE agreement >= 0.95) AS at_least_95, count(*) FILTER (WHERE agreement >= 0.85) AS at_least_85, min(agreement) FILTER (WHERE k = n // 10) AS p10 FROM r""")
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosscheck.summary(written(_agreement(spark, sf_dir), "agreement"))


@query("SELECT p.page_id, sha256(p.html) AS source_sha256, CASE WHEN p.page_id % 3 <> 0 THEN length(p.html) END AS source_length FROM pages p")
def texts_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows meet the source whose hash they recorded; some sources have changed since."""
    p = X.table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.sha2("html", 256).alias("source_sha256"))
    now = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return crosscheck.by_content(rows, p.select("page_id", F.sha2(now, 256).alias("source_sha256"), now.alias("text"))).select("page_id", "source_sha256", F.length("source_text").cast("long").alias("source_length"))


@query(f"""WITH p AS (SELECT doc_id, CASE WHEN strpos(lower(text), 'der') > 0 THEN 'deu_Latn' ELSE 'xyz_Latn' END AS label, CASE WHEN strpos(lower(text), 'der') > 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS conf FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents))
SELECT doc_id, CASE label WHEN 'deu_Latn' THEN 'German (deu_Latn)' ELSE label END AS name, conf FROM p WHERE conf < 0.5 OR doc_id % 2 = 0""")
def predicted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any model's predictions, reviewers' names, and the doubtful ones beside the even ids."""
    def predict(texts: list[str]) -> list[tuple[str, float]]:
        return [("deu_Latn", 0.75) if "der" in t.lower() else ("xyz_Latn", 0.25) for t in texts]

    found = language.predict_pages(X.table(spark, sf_dir, "documents").select("doc_id", "text"), predict)
    return found.where("conf < 0.5 or doc_id % 2 = 0").select("doc_id", columns.iso_name(F.col("label")).alias("name"), "conf")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '\\pL')) AS k, len(list_filter(string_split_regex(regexp_replace(t, '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS w FROM l)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE n BETWEEN 28 AND 140 AND w >= 5 AND k >= 0.5 * n) AS distinctive, CAST(sum(greatest(1, CASE WHEN n * 4 % 100 = 50 THEN n * 4 // 100 + (n * 4 // 100) % 2 ELSE (n * 4 + 50) // 100 END)) AS BIGINT) AS diffs FROM n GROUP BY doc_id""")
def distinctive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that could be looked for in another text, and the edits that all lines allow."""
    lines = X.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("t"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(columns.is_distinctive(F.col("t"))).alias("distinctive"), F.sum(columns.max_diffs(F.length("t"), pagetests.EDIT_SHARE)).cast("long").alias("diffs"))


_SIZES = "s AS (SELECT DISTINCT CAST(1 + l_partkey * 37 % 6000 AS BIGINT) AS w, CAST(1 + l_suppkey * 53 % 5000 + l_linenumber AS BIGINT) AS h FROM lineitem)"
_FIT_SQL = f"""WITH RECURSIVE {_SIZES},
f AS (SELECT w, h, CASE WHEN w * h > 6291456 THEN sqrt(6291456.0::DOUBLE / (w * h)) WHEN w * h < 50176 THEN sqrt(50176.0::DOUBLE / (w * h)) ELSE 1.0::DOUBLE END AS z FROM s),
b(w, h, c, r) AS (SELECT w, h, greatest(1, CAST(round_even(w * z / 28, 0) AS BIGINT)), greatest(1, CAST(round_even(h * z / 28, 0) AS BIGINT)) FROM f
  UNION ALL SELECT w, h, CASE WHEN r = 1 OR (c > 1 AND abs((c - 1) / r::DOUBLE - w / h::DOUBLE) < abs(c / (r - 1)::DOUBLE - w / h::DOUBLE)) THEN c - 1 ELSE c END,
         CASE WHEN r = 1 OR (c > 1 AND abs((c - 1) / r::DOUBLE - w / h::DOUBLE) < abs(c / (r - 1)::DOUBLE - w / h::DOUBLE)) THEN r ELSE r - 1 END FROM b WHERE c * r * 784 > 6291456 AND (c > 1 OR r > 1))
SELECT w, h, c * 28 AS width, r * 28 AS height, CAST((floor(c * 28 / 28) + 1) * floor(r * 28 / 28) AS BIGINT) AS tokens_28, CAST(ceil(w / 32.0) * ceil(h / 32.0) AS BIGINT) AS tokens_32 FROM b WHERE c * r * 784 <= 6291456"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = X.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((1 + F.col("l_partkey") * 37 % 6000).cast("long").alias("w"), (1 + F.col("l_suppkey") * 53 % 5000 + F.col("l_linenumber")).cast("long").alias("h")).distinct()


@query(_FIT_SQL)
def fitted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes on the grid of blocks, and what images cost in tokens."""
    sizes = _sizes(spark, sf_dir).withColumn("z", geometry.scale_to_fit("w", "h")).select("w", "h", "z.*")
    return sizes.select("*", columns.image_tokens(F.col("height"), F.col("width")).cast("long").alias("tokens_28"), columns.image_tokens(F.col("h"), F.col("w"), "patches_32").cast("long").alias("tokens_32"))


@query(f"""WITH {_SIZES}, r AS (SELECT w, h, greatest(28, CAST(round_even(h / 28.0, 0) AS BIGINT) * 28) AS a, greatest(28, CAST(round_even(w / 28.0, 0) AS BIGINT) * 28) AS b, sqrt(h * w / 1003520.0::DOUBLE) AS down, sqrt(101920.0::DOUBLE / (h * w)) AS up FROM s)
SELECT w, h, CASE WHEN a * b > 1003520 THEN greatest(28, CAST(floor(h / down / 28) AS BIGINT) * 28) WHEN a * b < 101920 THEN CAST(ceil(h * up / 28) AS BIGINT) * 28 ELSE a END AS height,
  CASE WHEN a * b > 1003520 THEN greatest(28, CAST(floor(w / down / 28) AS BIGINT) * 28) WHEN a * b < 101920 THEN CAST(ceil(w * up / 28) AS BIGINT) * 28 ELSE b END AS width FROM r""")
def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir).withColumn("z", columns.smart_resize(F.col("h"), F.col("w"))).select("w", "h", "z.*")
    return sizes.select("w", "h", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))
