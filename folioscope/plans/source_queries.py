"""Queries of sources and sinks (written, then read back), service runs and streams, and scored pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import columns
from folioscope.operators import consolidate, report, rescore, score, validate
from folioscope.plans import fixtures as X
from folioscope.plans.registry import query
from folioscope.plans.transform_queries import diplomatic_sql, reading_sql
from folioscope.sources import parts, responses, sinks
from folioscope.sources.shared import fresh_folder, written
from folioscope.streaming import ingest


def _local(uri: str) -> str:
    """The path of a shared folder that the file system mounts."""
    return re.sub("^file:/*", "/", uri)


# -- files -----------------------------------------------------------------------------


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked part files of at most 100 rows, and their union."""
    folder = fresh_folder(spark, "parts")
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    made = ingest.write_ranked_parts(rows, folder, 100).agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).first()
    found, n = parts.read_parts(spark, folder)
    if n != made["files"]:
        raise ValueError("a part file was not read")
    return found.drop("row_ord")


@query(f"WITH {X.CARDS_SQL} SELECT model, count(*) AS n, CAST(sum(rm) AS BIGINT) AS matched, count(*) FILTER (WHERE volume = 'v1') AS first_volume FROM c GROUP BY model")
def scorecard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards with a nested cell, in two files that three globs name."""
    folder = fresh_folder(spark, "cards")
    rows = sinks.flat_scorecards(X.cards(spark, sf_dir).withColumn("nested", F.struct("volume", "language")))
    for name, part in (("a", F.col("model") == "A"), ("b", F.col("model") != "A")):
        sinks.write_verified(rows.where(part), f"{folder}/{name}.parquet")
    found = parts.union_globs(spark, [f"{folder}/a.parquet", f"{folder}/b.parquet", f"{folder}/a.parquet"])
    first = F.get_json_object("nested", "$.volume") == "v1"
    return found.groupBy("model").agg(F.count("*").alias("n"), F.sum("recall_matched").alias("matched"), F.count_if(first).alias("first_volume"))


@query("SELECT source || '/p' || doc_id || '.md' AS rel, sha256(text) AS sha256 FROM documents")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file per page, and the hashes of the files."""
    folder = _local(fresh_folder(spark, "texts"))
    rel = F.concat("source", F.lit("/p"), F.col("doc_id").cast("string"), F.lit(".md"))
    sinks.write_texts(X.table(spark, sf_dir, "documents").select(rel.alias("md"), "text"), folder)
    found = parts.file_hashes(spark, f"{folder}/*/*.md")
    return found.select(F.substring_index("path", f"{folder}/", -1).alias("rel"), "sha256")


@query("SELECT doc_id, source || '/p' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.JPG' END AS rel, source || '/p' || doc_id || '.md' AS md, strlen(text) AS length, sha256(text) AS image FROM documents")
def image_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images below a folder with the text files that they would have, joined with the metadata of their pages."""
    folder = _local(fresh_folder(spark, "images"))
    rel = F.concat("source", F.lit("/p"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".JPG"))
    d = X.table(spark, sf_dir, "documents").withColumn("rel", rel)
    sinks.write_texts(d.select(F.col("rel").alias("md"), "text"), folder)
    found = parts.image_files(spark, folder)
    bytes_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.substring_index("path", f"{folder}/", -1).alias("path"), "content")
    pages = responses.with_images(d.select("doc_id", F.col("rel").alias("image_path")), bytes_)
    cells = pages.select("doc_id", F.col("image_path").alias("rel"), F.struct(F.col("image").alias("bytes")).alias("cell"))
    image = responses.image_bytes(F.col("cell"), dict(cells.dtypes)["cell"])
    return cells.join(found, "rel").select("doc_id", "rel", "md", F.col("length").cast("long").alias("length"), F.sha2(image, 256).alias("image"))


@query("SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM documents")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", responses.data_url(F.col("text").cast("binary"), "image/png").alias("url"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, sha256(array_to_string(list_filter(l[2:], lambda x: x <> ''), chr(10))) AS body, l[1] AS furniture,
CAST(len(list_filter(l, lambda x: x <> '')) AS BIGINT) AS regions, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE len(l) END AS items FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN CAST([''] AS VARCHAR[]) ELSE l END AS l FROM l)""")
def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and regions of layout documents: the first line is furniture; every ninth document has no items."""
    lines = F.split("text", "\n", -1)
    items = F.transform(lines, lambda t, i: F.struct(F.when(i == 0, "page_header").otherwise("text").alias("label"), F.when(i == 0, "furniture").otherwise("body").alias("content_layer"), t.alias("text")))
    document = F.when(F.col("doc_id") % 9 == 0, F.lit('{"name":"x"}')).otherwise(F.to_json(F.struct(items.alias("texts"))))
    d = X.table(spark, sf_dir, "documents").select("doc_id", document.alias("d"))
    regions = F.from_json(parts.regions(F.col("d")), "array<struct<label: string, text: string>>")
    return d.select("doc_id", F.sha2(parts.layer_text(F.col("d"), "body"), 256).alias("body"), parts.layer_text(F.col("d"), "furniture").alias("furniture"), F.size(regions).cast("long").alias("regions"), F.size(parts.layout(F.col("d"))).cast("long").alias("items"))


# -- answers, plans, runs -----------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS raw, CASE WHEN doc_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, 'm' AS model, length(text) AS prompt_tokens, doc_id AS completion_tokens,
'{"lang":"' || lang || '","source":"' || source || ': x"}' AS front FROM documents""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies as columns, and the front matter of a text."""
    message = F.struct(F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"))
    body = F.struct(F.lit("m").alias("model"), F.array(F.struct(message.alias("message"), F.when(F.col("doc_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"))).alias("choices"), F.struct(F.length("text").alias("prompt_tokens"), F.col("doc_id").alias("completion_tokens")).alias("usage"))
    front = F.concat(F.lit("---\nlang: "), "lang", F.lit("\nsource: "), "source", F.lit(": x\n---\n"), "text")
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.to_json(body).alias("b"), front.alias("t"))
    return d.select("doc_id", *(c.alias(n) for n, c in responses.parse_answer(F.col("b")).items()), responses.front_matter(F.col("t")).alias("front"))


@query("SELECT CASE WHEN doc_id % 6 = 0 AND text <> '' THEN 'length' ELSE 'stop' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of blocks of which one failed, with and without text."""
    blocks = F.to_json(F.array(F.struct(F.lit(False).alias("error"), F.lit("a").alias("html")), F.struct((F.col("doc_id") % 3 == 0).alias("error"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("html"))))
    return X.table(spark, sf_dir, "documents").select(responses.page_status(blocks).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id FROM documents) SELECT 'all' AS model, count(*) FILTER (WHERE doc_id % 97 = 0) AS pending FROM d UNION ALL SELECT 'none', count(*) FROM d UNION ALL SELECT 'total', count(*) FILTER (WHERE doc_id % 97 = 0) + count(*) FROM d""")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that models still need, one with answers (errors asked again) and one without."""
    made = responses.plan({"all": "u", "none": "u"}, X.truth(spark, sf_dir), {"all": X.parts(spark, sf_dir)}, retry_errors=True)
    return spark.createDataFrame([(r["model"], r["pending"]) for r in made], "model string, pending long")


def _request(prompt: str) -> tuple[str | None, str]:
    """A service: cut off, without content, failing, or fine, by the prompt's number."""
    number = int(prompt.split(" ")[0])
    if number % 11 == 1:
        raise TimeoutError(f"page {number}")
    if number % 11 == 2:
        return None, "stop"
    return (prompt[:10], "length") if number % 11 == 3 else (prompt.upper() if prompt.isascii() else prompt, "stop")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return X.table(spark, sf_dir, "documents").select(key.alias("page_id"), F.concat(key, F.lit(" "), F.substring("text", 1, 50)).alias("prompt"))


_PROMPT_SQL = "p AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS page_id, doc_id || ' ' || substr(text, 1, 50) AS prompt FROM documents)"
_ANSWER_SQL = "CASE doc_id % 11 WHEN 1 THEN '__ERR__TimeoutError' WHEN 2 THEN '__ERR__EmptyContent' WHEN 3 THEN '__ERR__FinishReason:length' ELSE CASE WHEN regexp_full_match(prompt, '[\\x00-\\x7F]*') THEN upper(prompt) ELSE prompt END END"


@query(f"WITH {_PROMPT_SQL} SELECT page_id, {_ANSWER_SQL} AS raw, CASE doc_id % 11 WHEN 1 THEN 'page ' || doc_id WHEN 2 THEN 'no content' END AS error FROM p")
def service_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service's answers with a window of calls that adapts to its queue."""
    return ingest.map_service(_prompts(spark, sf_dir), _request, workers=4, window=lambda: ingest.AdaptiveWindow(2, 3, 8, 2, lambda: 1))


@query(f"WITH {_PROMPT_SQL} SELECT page_id, CASE WHEN doc_id % 11 IN (1, 2) THEN 'again ' || page_id ELSE {_ANSWER_SQL} END AS raw FROM p")
def resumed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is resumed: only what had errors is asked again."""
    cache = fresh_folder(spark, "answers")
    prompts = _prompts(spark, sf_dir)
    ingest.resume(prompts, _request, cache, slices=2)
    return ingest.resume(prompts, lambda p: ("again " + p.split(" ")[0], "stop"), cache, slices=2).select("page_id", "raw")


@query(f"WITH {X.PARTS_SQL} SELECT page_id, sha256(raw) AS sealed FROM sealed")
def streamed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files taken in as a stream, in two arrivals; then the row of each page that counts."""
    folder, target, checkpoint = (fresh_folder(spark, k) for k in ("arrivals", "sealed", "progress"))
    rows = X.parts(spark, sf_dir).select(F.col("page_id").alias("id"), "raw", "error", "finish_reason", F.lit("m").alias("model"), "row_ord")
    for early in (True, False):
        rows.where((F.col("row_ord") % 2 == 0) == early).drop("row_ord").write.mode("append").parquet(folder)
        ingest.append_parts(spark, folder, target, checkpoint)
    return consolidate.seal(ingest.current(spark, target)).select("page_id", F.sha2("raw", 256).alias("sealed"))


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'deu+fra' WHEN 'src1' THEN 'lat' ELSE 'eng' END AS parameter FROM documents")
def volume_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its volume's parameter; one volume's is not installed and gives way to the default."""
    wanted = {"src0": "deu+fra", "src1": "lat", "src2": "xxx"}
    return ingest.with_volume_parameter(X.truth(spark, sf_dir), wanted, {"eng", "deu", "fra", "lat"}, "eng", strict=False).select("doc_id", "parameter")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[{\"model\":\"a\"},{\"model\":\"b\",\"run\":\"1\"}]' ELSE '[{\"model\":\"b\",\"run\":\"1\"}]' END AS info FROM documents")
def appended_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, '[{"model":"a"}]').alias("info"))
    return d.select("doc_id", sinks.append_info("info", {"model": "b", "run": 1}).alias("info"))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS pages FROM documents")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run's description; its hash of the outputs must not depend on their order."""
    outputs = X.truth(spark, sf_dir).select(F.col("page_key").alias("page_id"), F.col("text").alias("raw"))
    a, b = (sinks.run_provenance(df, {"model": "m"})["outputs"] for df in (outputs, outputs.repartition("raw")))
    if a != b:
        raise ValueError("the hash depends on the order of rows")
    return spark.createDataFrame([(a["rows"], a["unique"])], "rows long, pages long")


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(source, 'src1') THEN 0 ELSE 1 END, source, doc_id % 1000, doc_id) AS BIGINT) AS place FROM (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS page_id FROM documents WHERE doc_id % 1000 < 60)")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewers' page of doubtful pages, read back card by card."""
    conf = (F.col("doc_id") % 1000 + F.col("doc_id") / 1e9) / 1000.0
    rows = X.truth(spark, sf_dir).select(F.col("page_key").alias("page_id"), "volume", F.lit("x_Latn").alias("label"), conf.alias("conf"), "text")
    page = sinks.review_page(rows, 0.06, "src1")
    return spark.createDataFrame([(i, k + 1) for k, i in enumerate(re.findall(r'data-id="(\d+)"', page))], "page_id string, place long")


# -- boards -----------------------------------------------------------------------------


_BOARD_SQL = f"""WITH {X.CARDS_SQL}, g AS (SELECT model, {X.rate_sql('sum(s + d + i) FILTER (WHERE NOT error)', 'sum(s + d + h) FILTER (WHERE NOT error)')} AS cer FROM c GROUP BY model)
SELECT model, cer, CAST(row_number() OVER (ORDER BY cer NULLS LAST, model) AS BIGINT) AS place, 'type of ' || model AS kind FROM g"""


@query(_BOARD_SQL)
def baked_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's JSON, joined with the models' descriptions and baked into a page, as the page has it."""
    import json

    board = report.leaderboard(report.model_cards(written(X.cards(spark, sf_dir).select(*report.CARD_COLUMNS), "cards")), {"page_count": 1})
    rows, _ = sinks.board_rows(board, {m: {"kind": f"type of {m}"} for m in board["order"]})
    page = sinks.bake("<html><!-- rows:begin --><!-- rows:end --></html>", "rows", rows)
    found = json.loads(re.search(r'id="rows">(.*?)</script>', page, re.DOTALL)[1])
    return spark.createDataFrame([(r["model"], r["cer_reading_micro"], k + 1, r["kind"]) for k, r in enumerate(found)], "model string, cer double, place long, kind string")


@query(f"WITH {X.CARDS_SQL}, x AS (SELECT page_id, CASE WHEN k % 40 = 1 THEN -0.25 WHEN k % 40 = 2 THEN 0.25 END AS change FROM c WHERE cer IS NOT NULL) SELECT count(change) AS rows, count(DISTINCT page_id) FILTER (WHERE change IS NOT NULL) AS pages, count(*) FILTER (WHERE change < 0) AS better, count(*) FILTER (WHERE change > 0) AS worse FROM x")
def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new version of the scorer changed."""
    before = X.cards(spark, sf_dir).where("cer_reading is not null").select("model", "page_id", "cer_reading")
    k = F.split_part("page_id", F.lit("-"), F.lit(1)).cast("long") % 40
    after = before.withColumn("cer_reading", F.col("cer_reading") + F.when(k == 1, -0.25).when(k == 2, 0.25).otherwise(1e-14))
    return rescore.summary(rescore.compare(before, after))


# -- scored pages -----------------------------------------------------------------------

_READ = "length(" + reading_sql("text") + ")"
_WORDS = f"len({X.words_sql(reading_sql('text'))})"
_HEAD = "split_part(text, chr(10), 1)"


def _either(error: str, fine: str) -> str:
    return f"CASE WHEN doc_id % 97 = 0 THEN {error} ELSE {fine} END"


@query(f"""WITH x AS (SELECT doc_id, text, {_READ} AS n, length({diplomatic_sql('text')}) AS m, {_WORDS} AS w, len({X.words_sql(reading_sql(_HEAD))}) AS f, length(text) + 10 >= 80 AS long FROM documents),
y AS (SELECT *, CASE WHEN n > 0 THEN 1 ELSE 0 END AS gap_n, CASE WHEN m > 0 THEN 1 ELSE 0 END AS gap_m FROM x)
SELECT doc_id, doc_id % 97 = 0 AS error, {_either('0', 'w')} AS recall_matched, w AS recall_reference, {_either('0', '1')} AS extra, {_either('0', 'w + 3')} AS output, f AS furniture, {_either('0', 'f')} AS furniture_matched,
  {_either('0', '5')} AS read_i, {_either('n + gap_n + 7', '0')} AS read_d, {_either('0', 'n + gap_n + 7')} AS read_h, {_either('0', '5')} AS dip_i, {_either('m + gap_m + 7', '0')} AS dip_d,
  {_either('1.0::DOUBLE', X.rate_sql('5', '(n + gap_n + 7)'))} AS cer_reading, {_either('CASE WHEN w > 0 THEN 0.0::DOUBLE END', 'CASE WHEN w > 0 THEN 1.0::DOUBLE END')} AS recall, CASE WHEN long THEN 'content' ELSE 'sparse_blank' END AS sample_stratum FROM y""")
def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two illegible words, whose outputs have them and one word more; some outputs are error notes.

    A joined, masked, normalized, aligned and counted page is all that SQL has to say.
    """
    d = X.table(spark, sf_dir, "documents")
    truth = d.select(F.col("doc_id").cast("string").alias("page_key"), F.col("source").alias("volume"), F.col("lang").alias("language"), F.concat("text", F.lit(" qa�a qb�b")).alias("text"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("furniture_text"))
    out = d.select(columns.page_key(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".0 "))).alias("page_key"), F.lit("m").alias("model"), F.when(F.col("doc_id") % 97 == 0, " [ocr Error: x] ").otherwise(F.concat("text", F.lit(" qaza qbzb qczc"))).alias("text"))
    validate.check_join(out, truth)
    rows = score.score_pages(score.join_outputs(out, truth))
    return rows.select(F.col("page_id").cast("long").alias("doc_id"), "error", "recall_matched", "recall_reference", F.col("over_extraction_extra").alias("extra"), F.col("over_extraction_output").alias("output"), F.col("furniture_global_token_recall_reference").alias("furniture"), F.col("furniture_global_token_recall_matched").alias("furniture_matched"), F.col("cer_body_read_i").alias("read_i"), F.col("cer_body_read_d").alias("read_d"), F.col("cer_body_read_h").alias("read_h"), F.col("cer_body_dip_i").alias("dip_i"), F.col("cer_body_dip_d").alias("dip_d"), "cer_reading", "recall", "sample_stratum")
