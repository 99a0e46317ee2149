"""Ground truth and model outputs derived from ``documents``, in Spark and in SQL.

Pages are documents, volumes their sources; the first line is furniture, the rest body.
Models make fixed edits: ``m_typo`` misspells, ``m_drop`` loses the first line,
``m_loop`` repeats the end, ``m_partial`` leaves pages out; some rows are error notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rest(text):
    """What follows the first line."""
    cut = F.locate("\n", text)
    return F.when(cut == 0, "").otherwise(F.substring(text, cut + 1, F.length(text)))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("page_key"), "doc_id", F.col("source").alias("volume"), F.col("lang").alias("language"), "text", _rest(F.col("text")).alias("body_text"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("furniture_text"), F.to_json(F.array(F.struct(F.lit("header").alias("label"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")), F.struct(F.lit("body").alias("label"), _rest(F.col("text")).alias("text")))).alias("regions"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, page_key, text); one scan, four rows a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    broken = F.when(F.col("doc_id") % 97 == 0, F.lit("__ERR__Producer:timeout")).when(F.col("doc_id") % 89 == 0, F.lit("__ERR__FinishReason:length"))
    edits = {
        "m_typo": F.coalesce(broken, F.replace("text", F.lit("the"), F.lit("teh"))),
        "m_drop": _rest(F.col("text")),
        "m_loop": F.concat("text", F.repeat(F.right("text", F.lit(20)), F.lit(12))),
        "m_partial": F.when(F.col("doc_id") % 53 != 0, F.col("text")),
    }
    rows = F.array(*(F.struct(F.lit(m).alias("model"), t.alias("text")) for m, t in edits.items()))
    return d.select("doc_id", F.explode(rows).alias("o")).where("o.text is not null").select("o.model", F.col("doc_id").cast("string").alias("page_key"), "doc_id", "o.text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer rows with retries: an error, then a success for every 61st page; every 89th is cut off, every 97th fails."""
    d = table(spark, sf_dir, "documents")
    bad, cut = F.col("doc_id") % 97 == 0, F.col("doc_id") % 89 == 0
    none = F.lit(None).cast("string")
    first = d.select(F.col("doc_id").cast("string").alias("page_id"), F.when(~bad, F.col("text")).alias("raw"), F.when(bad, F.lit("timeout")).alias("error"), F.when(bad, none).when(cut, "length").otherwise("stop").alias("finish_reason"), (F.col("doc_id") * 2 + 1).alias("row_ord"))
    retry = d.where("doc_id % 61 = 0 and doc_id % 97 <> 0").select(F.col("doc_id").cast("string").alias("page_id"), none.alias("raw"), F.lit("busy").alias("error"), none.alias("finish_reason"), (F.col("doc_id") * 2).alias("row_ord"))
    return first.unionByName(retry)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language predictions of pages, with labels, confidences and page order."""
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("lang") == "en", "__label__eng_Latn").when(F.col("lang") == "de", "__label__deu_Latn").when(F.col("lang") == "fr", "__label__fra_Latn").otherwise("__label__spa_Latn")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.col("source").alias("volume"), "text", label.alias("label"), ((F.col("doc_id") % 10) / 10.0).alias("conf"), F.col("doc_id").alias("row_ord"))


def first_rows(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns ``names`` of the first row of each key, in the order of the table's files and of the rows in them."""
    rows = df.select(*names, F.col("_metadata.row_index").alias("__row"), F.col("_metadata.file_path").alias("__file"))
    files = sorted(r[0] for r in rows.select("__file").distinct().collect()) if len(df.inputFiles()) > 1 else []  # one row a file
    if files:
        places = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__file string, __n int")
        rows = rows.join(F.broadcast(places), "__file")
    else:
        rows = rows.withColumn("__n", F.lit(0))
    # Looking at the row before takes one shuffle and one sort; a rank or an aggregate of strings would sort twice.
    before = F.lag("__row").over(Window.partitionBy(*keys).orderBy("__n", "__row"))
    return rows.select(*names, "__n", "__row").withColumn("__before", before).where("__before is null").select(*names)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard rows made of order lines: a model a return flag, counts from the lines' numbers, valid in themselves.

    Of lines with one key the table's first counts, whoever computes them.
    """
    rows = first_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_suppkey"])
    q, p, k, o = (F.col(c).cast("long") for c in ("l_quantity", "l_suppkey", "l_orderkey", "l_linenumber"))
    rows = rows.select(
        F.col("l_returnflag").alias("model"),
        F.concat_ws("-", k.cast("string"), o.cast("string")).alias("page_id"),
        F.concat(F.lit("v"), (p % 4).cast("string")).alias("volume"),
        F.when(k % 3 == 0, "en").when(k % 3 == 1, "de").alias("language"),
        F.when(o % 2 == 0, "latin").otherwise("greek").alias("gt_script"),
        (k % 50 == 7).alias("error"),
        (k % 100 == 7).alias("truncated"),
        F.when(o == 1, "content").otherwise("sparse_blank").alias("sample_stratum"),
        F.lit(C.STRATUM_THRESHOLD).alias("sample_stratum_threshold"),
        *(x.cast("long").alias(f"{key}_{name}") for key in C.COUNT_KEYS for name, x in (("s", q % 7), ("d", p % 5), ("i", k % 3), ("h", (k + o) % 90))),
        q.alias("recall_reference"), F.least(q, k % 60).alias("recall_matched"),
        (q * 2).alias("over_extraction_output"), (k % 3).alias("over_extraction_extra"),
        (q % 4).alias("furniture_global_token_recall_reference"), (q % 2).alias("furniture_global_token_recall_matched"),
        ((k % 10) / 10.0).alias("script_match"),
        F.to_json(F.create_map(F.lit("body"), F.struct(columns.rate(k % 2, F.lit(4)).alias("rate"), (k % 2).alias("matched"), F.lit(4).cast("long").alias("reference")))).alias("region_global_token_recall"),
    )
    of = lambda pair: columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[pair]))
    edits = lambda key: columns.rate(sum((F.col(f"{key}_{x}") for x in "di"), F.col(f"{key}_s")), sum((F.col(f"{key}_{x}") for x in "dh"), F.col(f"{key}_s")))
    rows = rows.withColumns({"recall": of(0), "over_extraction": F.coalesce(of(1), F.lit(0.0)), "furniture_global_token_recall": of(2), "cer_diplomatic": edits("cer_body_dip"), "cer_reading": edits("cer_body_read")})
    fixed = {"norm_version": C.NORM_VERSION, "scorer_version": C.SCORER_VERSION, "scorecard_schema_version": C.SCORECARD_SCHEMA_VERSION, "postproc_version": C.NO_POSTPROC, "score_provenance": columns.stable_json(dict.fromkeys(C.SCORE_FIELDS, "x")), "run_provenance": '{"run":1}'}
    return rows.withColumns({name: F.lit(v) for name, v in fixed.items()})


GT_SQL = """gt AS (SELECT CAST(doc_id AS VARCHAR) AS page_key, doc_id, source AS volume, lang AS language, text,
  CASE WHEN strpos(text, chr(10)) = 0 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1) END AS body_text, split_part(text, chr(10), 1) AS furniture_text FROM documents)"""
OUT_SQL = """o AS (SELECT * FROM (
  SELECT 'm_typo' AS model, CAST(doc_id AS VARCHAR) AS page_key, doc_id, CASE WHEN doc_id % 97 = 0 THEN '__ERR__Producer:timeout' WHEN doc_id % 89 = 0 THEN '__ERR__FinishReason:length' ELSE replace(text, 'the', 'teh') END AS text FROM documents
  UNION ALL SELECT 'm_drop', CAST(doc_id AS VARCHAR), doc_id, CASE WHEN strpos(text, chr(10)) = 0 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1) END FROM documents
  UNION ALL SELECT 'm_loop', CAST(doc_id AS VARCHAR), doc_id, text || repeat(right(text, 20), 12) FROM documents
  UNION ALL SELECT 'm_partial', CAST(doc_id AS VARCHAR), doc_id, text FROM documents WHERE doc_id % 53 <> 0) WHERE text IS NOT NULL)"""
PARTS_SQL = """parts AS (SELECT CAST(doc_id AS VARCHAR) AS page_id, CASE WHEN doc_id % 97 <> 0 THEN text END AS raw, CASE WHEN doc_id % 97 = 0 THEN 'timeout' END AS error,
    CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 89 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, doc_id * 2 + 1 AS row_ord FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'busy', NULL, doc_id * 2 FROM documents WHERE doc_id % 61 = 0 AND doc_id % 97 <> 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CAST(raw IS NULL OR error IS NOT NULL AS INT), row_ord) AS r FROM parts) WHERE r = 1),
sealed AS (SELECT page_id, finish_reason, row_ord, raw AS raw_verbatim, CASE WHEN raw IS NULL OR error IS NOT NULL THEN '__ERR__Producer:' || coalesce(error, 'empty response')
    WHEN finish_reason IS NOT NULL AND finish_reason <> 'stop' THEN '__ERR__FinishReason:' || finish_reason ELSE raw END AS raw FROM latest)"""


def words_sql(text: str) -> str:
    """Tokens of a text, as SQL."""
    return f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^\\pL\\pN_\\s\\x{{FFFD}}]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def round4_sql(x: str) -> str:
    """round4 as SQL: the exact comparison of x * 20000 with 2k + 1."""
    k = f"floor({x} * 10000.0::DOUBLE)"
    scaled = f"({x} * 134217729.0::DOUBLE)"
    high = f"({scaled} - ({scaled} - {x}))"
    side = f"(({high} * 20000.0::DOUBLE - ({k} * 2 + 1)) + ({x} - {high}) * 20000.0::DOUBLE)"
    return f"(({k} + CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 ELSE CAST({k} AS BIGINT) % 2 END) / 10000.0::DOUBLE)"


def rate_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {round4_sql(f'(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE))')} END"


#: The same scorecards; ``c`` has one group of counts, as all groups are equal.
CARDS_SQL = f"""l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_returnflag AS model, CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS o, CAST(l_quantity AS BIGINT) AS q, CAST(l_suppkey AS BIGINT) AS p FROM lineitem),
n AS (SELECT model, k, o, k || '-' || o AS page_id, 'v' || (p % 4) AS volume, CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, CASE WHEN o % 2 = 0 THEN 'latin' ELSE 'greek' END AS gt_script,
  k % 50 = 7 AS error, k % 100 = 7 AS truncated, CASE WHEN o = 1 THEN 'content' ELSE 'sparse_blank' END AS sample_stratum, q % 7 AS s, p % 5 AS d, k % 3 AS i, (k + o) % 90 AS h,
  q AS rr, least(q, k % 60) AS rm, q * 2 AS oo, k % 3 AS oe, q % 4 AS fr, q % 2 AS fm, (k % 10) / 10.0::DOUBLE AS script_match, k % 2 AS bm FROM l),
c AS (SELECT *, {rate_sql('rm', 'rr')} AS recall, coalesce({rate_sql('oe', 'oo')}, 0.0) AS over_extraction, {rate_sql('(s + d + i)', '(s + d + h)')} AS cer FROM n)"""
