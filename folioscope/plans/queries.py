"""Queries of the engine's operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import columns, lanes, script
from folioscope.operators import consolidate, crosscheck, language, multiset, pagetests, postproc, report, sampling, score, validate
from folioscope.plans import fixtures as X
from folioscope.plans.registry import ORACLE_SQL, QUERIES, query
from folioscope.sources.shared import spread, written

def _words(text) -> F.Column:
    return columns.token_text(F.lower(text))


def _supports(spark: SparkSession, sf_dir: str, part: str, by: list[str]) -> DataFrame:
    """Matched, reference and output tokens per (by) of every model's pages."""
    out = X.outputs(spark, sf_dir).withColumn("text", F.when(columns.is_error(F.col("text")), "").otherwise(F.col("text")))
    # Words of a page are made once, not once for each model.
    ref = spread(X.truth(spark, sf_dir).select("page_key", F.col(part).alias("ref")), "page_key").withColumn("ref", _words(F.col("ref")))
    pages = multiset.supports(spread(out, "page_key").join(ref, "page_key"), ["model", "page_key"], F.col("ref"), _words(F.col("text")))
    return pages if by == ["model", "page_key"] else pages.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("matched", "reference", "output")))


def _supports_sql(part: str) -> str:
    return f"""WITH {X.GT_SQL}, {X.OUT_SQL},
c AS (SELECT model, page_key, CASE WHEN text LIKE '\\_\\_ERR\\_\\_%' ESCAPE '\\' OR regexp_full_match(text, '(?i)\\s*\\[[^\\]]*error[^\\]]*\\]\\s*') THEN '' ELSE text END AS text FROM o),
ow AS (SELECT model, page_key, t, count(*) AS n FROM (SELECT model, page_key, unnest({X.words_sql("text")}) AS t FROM c) GROUP BY ALL),
rw AS (SELECT model, page_key, t, count(*) AS n FROM (SELECT model, o.page_key, unnest({X.words_sql("gt." + part)}) AS t FROM o JOIN gt USING (page_key)) GROUP BY ALL),
p AS (SELECT model, page_key, CAST(sum(least(coalesce(rw.n, 0), coalesce(ow.n, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(rw.n, 0)) AS BIGINT) AS reference, CAST(sum(coalesce(ow.n, 0)) AS BIGINT) AS output
      FROM rw FULL JOIN ow USING (model, page_key, t) GROUP BY ALL),
m AS (SELECT model, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(reference) AS BIGINT) AS reference, CAST(sum(output) AS BIGINT) AS output FROM p GROUP BY model)
"""


@query(_supports_sql("text") + f"SELECT model, matched, reference, {X.rate_sql('matched', 'reference')} AS recall FROM m")
def recall_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supports(spark, sf_dir, "text", ["model"]).select("model", "matched", "reference", columns.rate(F.col("matched"), F.col("reference")).alias("recall"))


@query(_supports_sql("text") + f"SELECT model, output - matched AS extra, output, coalesce({X.rate_sql('(output - matched)', 'output')}, 0.0) AS over_extraction FROM m")
def over_extraction_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.col("output") - F.col("matched")
    return _supports(spark, sf_dir, "text", ["model"]).select("model", extra.alias("extra"), "output", F.coalesce(columns.rate(extra, F.col("output")), F.lit(0.0)).alias("over_extraction"))


@query(_supports_sql("furniture_text") + f"SELECT model, matched, reference, {X.rate_sql('matched', 'reference')} AS recall FROM m")
def furniture_recall_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supports(spark, sf_dir, "furniture_text", ["model"]).select("model", "matched", "reference", columns.rate(F.col("matched"), F.col("reference")).alias("recall"))


@query(_supports_sql("text") + f"SELECT page_key, {X.rate_sql('matched', 'reference')} AS recall FROM p WHERE model = 'm_typo' AND reference > 0 ORDER BY recall, page_key LIMIT 15")
def lowest_recall_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _supports(spark, sf_dir, "text", ["model", "page_key"]).where("model = 'm_typo' and reference > 0")
    return crosscheck.lowest(pages.select("page_key", columns.rate(F.col("matched"), F.col("reference")).alias("recall")), 15, 2.0, "recall")


@query(_supports_sql("text") + f""", b AS (SELECT model, 1 - {X.rate_sql('matched', 'reference')} AS miss FROM m),
x AS (SELECT b.model, miss, (SELECT count(*) FROM gt WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.model = b.model AND o.page_key = gt.page_key)) AS missing,
        (SELECT count(*) FROM o WHERE o.model = b.model AND o.text LIKE '\\_\\_ERR\\_\\_%' ESCAPE '\\' AND o.text NOT LIKE '\\_\\_ERR\\_\\_FinishReason%' ESCAPE '\\') AS producer_errors FROM b)
SELECT model, missing, producer_errors, missing = 0 AND producer_errors = 0 AS eligible, row_number() OVER (PARTITION BY missing = 0 AND producer_errors = 0 ORDER BY miss NULLS LAST, model) AS place FROM x""")
def board_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, errors, eligibility and places of the models by missed words."""
    missed = _supports(spark, sf_dir, "text", ["model"]).select("model", (1 - columns.rate(F.col("matched"), F.col("reference"))).alias("cer_reading_micro"))
    out, truth = X.outputs(spark, sf_dir).withColumnRenamed("page_key", "page_id"), X.truth(spark, sf_dir)
    absent = report.missing_pages(out, truth).select("model", "missing")
    extra = report.extra_pages(out, truth)
    errors = out.groupBy("model").agg(F.count_if(columns.is_error(F.col("text")) & ~columns.is_truncated(F.col("text"))).alias("producer_errors"))
    cards = missed.join(errors, "model").join(absent, "model", "left").join(extra, "model", "left").fillna(0, ["missing", "extra"])
    cards = cards.withColumns({"cer_diplomatic_micro": F.col("cer_reading_micro"), "benchmark_page_set_match": (F.col("missing") == 0) & (F.col("extra") == 0)})
    cards = cards.withColumn("eligible", report.eligible())
    return report.board_order(cards).select("model", "missing", "producer_errors", "eligible", F.col("place").cast("long").alias("place"))


_REGION_SQL = f"""WITH {X.GT_SQL}, {X.OUT_SQL},
g AS (SELECT doc_id, 'header' AS label, furniture_text AS text FROM gt UNION ALL SELECT doc_id, 'body', body_text FROM gt),
r AS (SELECT doc_id, label, t, count(*) AS n FROM (SELECT doc_id, label, unnest({X.words_sql('text')}) AS t FROM g) GROUP BY ALL),
w AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({X.words_sql('text')}) AS t FROM o WHERE model = 'm_drop') GROUP BY ALL)
SELECT label, CAST(sum(least(r.n, coalesce(w.n, 0))) AS BIGINT) AS matched, CAST(sum(r.n) AS BIGINT) AS reference FROM r LEFT JOIN w USING (doc_id, t) GROUP BY label"""


@query(_REGION_SQL)
def region_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each region label found anywhere in a model's page, pooled from the pages' JSON objects."""
    regions = X.truth(spark, sf_dir).select("page_key", F.explode(F.from_json("regions", "array<struct<label: string, text: string>>")).alias("r")).select("page_key", "r.label", F.col("r.text").alias("ref"))
    out = X.outputs(spark, sf_dir).where("model = 'm_drop'").select("model", "page_key", "text")
    found = multiset.supports(spread(out, "page_key").join(spread(regions, "page_key"), "page_key"), ["model", "page_key", "label"], _words(F.col("ref")), _words(F.col("text"))).where("reference > 0")
    value = F.struct(columns.rate(F.col("matched"), F.col("reference")).alias("rate"), "matched", "reference")
    pages = found.groupBy("model", "page_key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", value)))).alias("region_global_token_recall"))
    return report.region_recall(pages, ["model"]).select("label", "matched", "reference")


@query(f"SELECT source AS volume, t AS token, count(*) AS n FROM (SELECT source, unnest({X.words_sql('text')}) AS t FROM documents) GROUP BY ALL")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token occurs in each volume."""
    return multiset.token_counts(X.truth(spark, sf_dir), ["volume"], columns.tokens(F.lower("text")))


@query("SELECT source AS volume, CASE WHEN length(text) >= 80 THEN 'content' ELSE 'sparse_blank' END AS sample_stratum, count(*) AS n FROM documents GROUP BY ALL")
def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.truth(spark, sf_dir).groupBy("volume", columns.stratum(F.col("text")).alias("sample_stratum")).agg(F.count("*").alias("n"))


@query("SELECT source AS volume, sha256(CAST(to_json(list_sort(list(CAST(doc_id AS VARCHAR)))) AS VARCHAR)) AS fingerprint FROM documents GROUP BY source")
def volume_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.group_fingerprints(X.truth(spark, sf_dir), "volume")


@query(f"WITH {X.GT_SQL}, {X.OUT_SQL} SELECT m.model, count(*) AS missing, list_sort(list(gt.page_key))[1:3] AS examples FROM (SELECT DISTINCT model FROM o) m, gt WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.model = m.model AND o.page_key = gt.page_key) GROUP BY m.model")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.missing_pages(X.outputs(spark, sf_dir).withColumnRenamed("page_key", "page_id"), X.truth(spark, sf_dir))


@query("SELECT 'm' AS model, count(*) AS extra FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) HAVING count(*) > 0")
def extra_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.truth(spark, sf_dir).select(F.lit("m").alias("model"), F.col("page_key").alias("page_id"))
    return report.extra_pages(rows, X.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("page_key")))


@query(f"WITH {X.PARTS_SQL} SELECT page_id, row_ord, raw IS NULL OR error IS NOT NULL AS failed FROM latest")
def retry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.latest(X.parts(spark, sf_dir)).select("page_id", "row_ord", (F.col("raw").isNull() | F.col("error").isNotNull()).alias("failed"))


@query(f"WITH {X.PARTS_SQL} SELECT page_id, sha256(raw) AS sealed, sha256(coalesce(raw_verbatim, '')) AS verbatim FROM sealed")
def sealed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.consolidate(X.parts(spark, sf_dir)).select("page_id", F.sha2("raw", 256).alias("sealed"), F.sha2(F.coalesce("raw_verbatim", F.lit("")), 256).alias("verbatim"))


@query(f"""WITH {X.PARTS_SQL}, c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE raw NOT LIKE '\\_\\_ERR\\_\\_%' ESCAPE '\\') AS ok,
count(*) FILTER (WHERE raw LIKE '\\_\\_ERR\\_\\_Producer%' ESCAPE '\\') AS producer_errors, count(*) FILTER (WHERE raw LIKE '\\_\\_ERR\\_\\_FinishReason%' ESCAPE '\\') AS truncated FROM sealed)
SELECT rows, ok, producer_errors, truncated, {X.rate_sql('truncated', 'rows')} AS truncation_rate, (SELECT count(*) FROM parts) - rows AS superseded_by_retry FROM c""")
def seal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.parts(spark, sf_dir)
    return consolidate.counts(parts, consolidate.consolidate(parts)).drop("finish_reasons")


@query(f"WITH {X.PARTS_SQL} SELECT finish_reason, count(*) AS n FROM sealed WHERE finish_reason IS NOT NULL GROUP BY finish_reason")
def finish_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.consolidate(X.parts(spark, sf_dir)).where("finish_reason is not null").groupBy("finish_reason").agg(F.count("*").alias("n"))


@query(f"WITH {X.PARTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS page_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT page_id FROM parts WHERE raw IS NOT NULL AND error IS NULL)")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"))
    return consolidate.pending(wanted, X.parts(spark, sf_dir), retry_errors=True)


_MAJORITY_SQL = """p AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, source AS volume, text, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' ELSE 'und' END AS code, (doc_id % 10) / 10.0::DOUBLE AS conf, doc_id AS row_ord FROM documents),
v AS (SELECT volume, code, count(*) AS n, min(row_ord) AS f FROM p WHERE conf >= 0.5 AND code <> 'und' AND length(text) >= 100 GROUP BY ALL),
b AS (SELECT volume, code FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY n DESC, f) AS r FROM v) WHERE r = 1),
m AS (SELECT DISTINCT p.volume, coalesce(b.code, 'und') AS language FROM p LEFT JOIN b ON p.volume = b.volume)"""


@query(f"WITH {_MAJORITY_SQL} SELECT volume, language FROM m")
def language_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.majority(X.predictions(spark, sf_dir))


@query(f"WITH {_MAJORITY_SQL} SELECT page_id, CASE WHEN row_ord % 3 = 0 THEN 'xx' ELSE m.language END AS language FROM p JOIN m USING (volume)")
def restamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.predictions(spark, sf_dir)
    rows = pages.select("page_id", F.lit("xx").alias("language"), "row_ord")
    labels = language.label_pages(pages).select("page_id", F.when(F.col("row_ord") % 3 != 0, F.col("language")).alias("language"))
    return language.restamp(rows, labels).select("page_id", "language")


@query("SELECT doc_id FROM documents WHERE doc_id % 7 = 3")
def shard_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shard(X.table(spark, sf_dir, "documents"), 3, 7, "doc_id").select("doc_id")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS lo, round(median(value), 6) AS mid, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(report.percentile(F.col("value"), 0.025), 6).alias("lo"), F.round(report.percentile(F.col("value"), 0.5), 6).alias("mid"), F.round(report.percentile(F.col("value"), 0.975), 6).alias("hi"))


_MARKED = "'  <p>' || text || chr(10) || chr(10) || '<img src=\"images/bbox_1_2.png\">' || chr(10) || chr(10) || '>>UNUSED_12<< ![x](y.png) end' || chr(10)"


@query(f"""WITH t AS (SELECT doc_id, {_MARKED} AS t FROM documents), s AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM t)
SELECT doc_id, sha256(array_to_string(list_filter(string_split(t, chr(10) || chr(10)), lambda b: NOT starts_with(trim(b), '<img src="images/bbox_')), chr(10) || chr(10))) AS boxes,
sha256(regexp_replace(t, '>>UNUSED_[0-9]+<<', '', 'g')) AS unused, sha256(regexp_replace(t, '!\\[[^\\]\\n]*\\]\\([^)\\n]*\\)', '', 'g')) AS links FROM s""")
def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that run as expressions, one model each."""
    text = F.concat(F.lit("  <p>"), "text", F.lit('\n\n<img src="images/bbox_1_2.png">\n\n>>UNUSED_12<< ![x](y.png) end\n'))
    chain = lambda m: F.sha2(postproc.expression(postproc.REGISTRY[m], text), 256)
    return X.table(spark, sf_dir, "documents").select("doc_id", chain("ATH-MaaS/OvisOCR2").alias("boxes"), chain("tiiuae/Falcon-OCR").alias("unused"), chain("SoMarkAI/OXR-1.0").alias("links"))


@query("SELECT page_id, regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '(^|\\.)example\\.(com|org)$') AS routed FROM pages")
def routed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", columns.host_matches(F.col("url"), ["example.com", "example.org"]).alias("routed"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'model' ELSE s END AS slug FROM (SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 80) AS s FROM pages)")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "pages").select("page_id", columns.slug(F.col("url")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS page_key FROM lineitem")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole floats as the ids that they stand for."""
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", columns.page_key(F.col("l_quantity").cast("double")).alias("page_key"))


@query(f"WITH r AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE / (l_quantity::DOUBLE + l_tax::DOUBLE) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, {X.round4_sql('x')} AS x FROM r")
def rounded_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", columns.round4(F.col("l_discount").cast("double") / (F.col("l_quantity").cast("double") + F.col("l_tax").cast("double"))).alias("x"))


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated(X.table(spark, sf_dir, "conversations"), ["conv_id"]).withColumnRenamed("n", "turns")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their labels: semi filter and look-up."""
    return X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


# -- without SQL: alignment, normalization, sampling, validation; tested against brute force --


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_pages(score.join_outputs(X.outputs(spark, sf_dir), X.truth(spark, sf_dir)))


@query()
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("model", "page_id", "error", *(a.name for a in score.AXES), "gt_script")


@query()
def model_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Cards read scorecards several times; written, the alignment runs once.
    rows = written(_scored(spark, sf_dir), "scorecards")
    return report.board_order(report.model_cards(rows, X.truth(spark, sf_dir))).select("model", "n", "errors", "truncated", "missing", "eligible", "place", "cer_diplomatic_micro", "cer_reading_micro", "recall_micro", "over_extraction_micro", "cer_ci.lo", "cer_ci.hi")


@query()
def normalized_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").withColumn("n", lanes.normalize("text"))
    return d.select("doc_id", F.sha2("n.diplomatic", 256).alias("diplomatic"), F.sha2("n.reading", 256).alias("reading"))


@query()
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", script.dominant_script_udf("text").alias("script"))


@query()
def postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models: one chain of expressions, one in Python."""
    d = X.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "tiiuae/Falcon-OCR").otherwise("allenai/olmOCR-2-7B-1025-FP8").alias("model"), F.concat(F.lit("---\nlanguage: x\n---\n"), "text").alias("raw"))
    return postproc.normalize_frame(rows).select("doc_id", F.sha2("markdown", 256).alias("markdown"), F.array_join("transforms_applied", ",").alias("transforms"))


@query()
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards with planted faults and what is found in them."""
    rows = written(_scored(spark, sf_dir), "scorecards").withColumn("recall", F.when(F.col("page_id") == "5", 2.0).otherwise(F.col("recall"))).withColumn("sample_stratum", F.when(F.col("page_id") == "7", "odd").otherwise(F.col("sample_stratum")))
    return validate.violations(rows)


@query()
def volume_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.truth(spark, sf_dir).withColumn("sample_stratum", columns.stratum(F.col("text")))
    return sampling.volume_spread_sample(pages, 100, 1).select("page_key", "volume", "sample_stratum")


@query()
def page_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetests.with_ids(pagetests.generate(spread(X.truth(spark, sf_dir)))).select("test_id", "page_key", "test_type", "basis", "target_norm", "before_norm", "after_norm")


# Registered by being imported.
from folioscope.plans import report_queries, source_queries, transform_queries  # noqa: E402, F401
