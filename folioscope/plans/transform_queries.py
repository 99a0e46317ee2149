"""Queries of the text transforms and lanes: marks are planted into the documents, SQL says what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import align, lanes, script
from folioscope.operators import postproc
from folioscope.plans import fixtures as X
from folioscope.plans.registry import query
from folioscope.sources.shared import spread

#: Letters, digits and single spaces of a text: nothing that Markdown escapes.
_BARE_SQL = "trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))"
_STRIP_SQL = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _bare() -> Column:
    return F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))


def _planted() -> dict[str, Column]:
    """Raw output of each model, of rows with ``bare`` texts."""
    bare = F.col("bare")
    blocks = [(1, False, F.concat(F.lit("<p>"), bare, F.lit("</p>"))), (2, True, F.lit("gone")), (0, False, F.lit("17"))]
    return {
        "rednote-hilab/dots.ocr": F.concat(F.lit("\t \u00a0\n"), "text", F.lit("\u2003\n")),
        "rednote-hilab/dots.mocr": F.lit("  "),
        "google/gemma-4-12B-it": F.concat(F.lit("```markdown\n"), "text", F.lit("\n```")),
        "Qwen/Qwen3.5-9B": F.concat(F.lit("```"), "text"),
        "tencent/HunyuanOCR": F.concat("text", F.repeat(F.lit("xyzw"), 600)),
        "numind/NuExtract3": F.concat(F.lit("<think>a\nb</think>\n"), "text"),
        "baidu/Qianfan-OCR": F.concat(F.when(F.col("doc_id") % 5 == 0, "<think>").otherwise("<think>a</think>"), "text"),
        "allenai/olmOCR-2-7B-1025-FP8": F.concat(F.lit("---\nlanguage: x\n---\n"), "text"),
        "ATH-MaaS/OvisOCR2": F.concat(F.lit('<img src="images/bbox_1.png">\n\n'), bare, F.lit('\n\n <img src="images/bbox_2.png">')),
        "baidu/Unlimited-OCR": F.concat(F.lit("<｜begin▁of▁sentence｜><|det|>title [1, 2, 3, 4]<|/det|>Head\n<|det|>image [5, 6, 7, 8]<|/det|>\n<|det|>text [1, 2, 3, 9]<|/det|>"), bare, F.lit("<｜end▁of▁sentence｜>")),
        "deepseek-ai/DeepSeek-OCR": F.concat(F.lit("<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\n"), bare, F.lit("\n\n\n\nend")),
        "deepseek-ai/DeepSeek-OCR-2": F.concat(bare, F.lit(" <|odd|>")),
        "datalab-to/chandra-ocr-2": F.concat(F.lit('<div data-label="Page-Header"><p>h</p></div><div data-label="Section-Header"><h2>Part</h2></div><div data-label="Text">'), bare, F.lit('</div><div data-label="Figure"><img alt="x"></div>')),
        "datalab-to/surya-ocr-2.5": F.to_json(F.array(*(F.struct(F.lit(k).alias("reading_order"), F.lit(skip).alias("skipped"), html.alias("html"), F.lit("Text").alias("raw_label"), F.lit("text").alias("label")) for k, skip, html in blocks))),
        "tiiuae/Falcon-OCR": F.concat(F.lit(">>UNUSED_7<<"), bare, F.lit(">>UNUSED_12<<")),
        "SoMarkAI/OXR-1.0": F.concat(F.lit("![a](b.png)"), bare, F.lit("![](c)")),
        "baidu/Unlimited-OCR-2": F.concat(F.lit("<PAGE><BLOCK>title<LEVEL2>[1, 2, 3, 4]<FORK>Part\n<BLOCK>image[1, 2, 3, 4]<FORK>\n<BLOCK>text[1, 2, 3, 5]<FORK>"), bare, F.lit("<MERGE><BLOCK>text[1, 2, 3, 6]<FORK>more<PAGE>plain page")),
    }


_TEXT = _STRIP_SQL.format("text")
#: What is left of it; null: an error note.
_LEFT = {
    "rednote-hilab/dots.ocr": _TEXT,
    "rednote-hilab/dots.mocr": "''",
    "google/gemma-4-12B-it": _TEXT,
    "Qwen/Qwen3.5-9B": _STRIP_SQL.format("'```' || text"),
    "tencent/HunyuanOCR": _STRIP_SQL.format("text || 'xyzw'"),
    "numind/NuExtract3": _TEXT,
    "baidu/Qianfan-OCR": f"CASE WHEN doc_id % 5 <> 0 THEN {_TEXT} END",
    "allenai/olmOCR-2-7B-1025-FP8": _STRIP_SQL.format("text"),
    "ATH-MaaS/OvisOCR2": _BARE_SQL,
    "baidu/Unlimited-OCR": f"trim('Head' || chr(10) || chr(10) || {_BARE_SQL}, chr(10))",
    "deepseek-ai/DeepSeek-OCR": f"trim({_BARE_SQL} || chr(10) || chr(10) || 'end', chr(10))",
    "deepseek-ai/DeepSeek-OCR-2": "CAST(NULL AS VARCHAR)",
    "datalab-to/chandra-ocr-2": f"trim('## Part' || chr(10) || chr(10) || {_BARE_SQL}, chr(10))",
    "datalab-to/surya-ocr-2.5": f"trim('17' || chr(10) || chr(10) || {_BARE_SQL}, chr(10))",
    "tiiuae/Falcon-OCR": _BARE_SQL,
    "SoMarkAI/OXR-1.0": _BARE_SQL,
    "baidu/Unlimited-OCR-2": f"'## Part' || chr(10) || chr(10) || {_BARE_SQL} || 'more' || chr(10) || chr(10) || 'plain page'",
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, sha256(coalesce({sql}, '')) AS markdown, {sql} IS NULL AS failed FROM documents" for m, sql in _LEFT.items()))
def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of chain, with the marks that it is there for."""
    # Nine models have the bare text: it is made before the shuffle, so once and not for each.
    rows = spread(X.table(spark, sf_dir, "documents").select("doc_id", "text", _bare().alias("bare"))).select("doc_id", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), raw.alias("raw")) for m, raw in _planted().items()))).alias("o")).select("doc_id", "o.model", "o.raw")
    got = postproc.normalize_frame(rows)
    failed = F.col("normalize_error").isNotNull()
    return got.select("doc_id", "model", F.sha2(F.when(failed, "").otherwise(F.col("markdown")), 256).alias("markdown"), failed.alias("failed"))


@query("SELECT 'tiiuae/Falcon-OCR' AS model, 'strip_outer_whitespace,falcon_strip_unused_tokens' AS applied, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'baidu/Qianfan-OCR', 'strip_outer_whitespace', count(*) FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT m, '', count(*) FROM documents, (VALUES ('tiiuae/Falcon-OCR'), ('baidu/Qianfan-OCR')) v(m) WHERE doc_id % 3 = 0 GROUP BY m")
def applied_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded: all steps, the steps before a failure, none for sealed rows."""
    d = X.table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("__ERR__Producer:x")).otherwise(F.concat(F.lit("<think>"), "text"))
    rows = d.select(F.explode(F.array(F.lit("tiiuae/Falcon-OCR"), F.lit("baidu/Qianfan-OCR"))).alias("model"), raw.alias("raw"))
    return postproc.normalize_frame(rows).groupBy("model", F.array_join("transforms_applied", ",").alias("applied")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256(replace(trim(regexp_replace(text, '[^A-Za-z0-9\\n]+', ' ', 'g')), '_', '') || ' a word snake_case') AS plain FROM documents")
def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underscores round words go, those within stay."""
    marked = F.concat(F.trim(F.regexp_replace("text", r"[^A-Za-z0-9\n]+", " ")), F.lit(" _a word_ snake_case"))
    rows = X.table(spark, sf_dir, "documents").select("doc_id", marked.alias("t"))
    return rows.select("doc_id", F.sha2(postproc.column(postproc.strip_underscore_emphasis)("t"), 256).alias("plain"))


# -- lanes -------------------------------------------------------------------------

_TAGS = "|".join(lanes.TAG_NAMES)


def strip_markup_sql(text: str) -> str:
    steps = [r"<\|/?[A-Za-z0-9_]+\|>", r"\[\[\s*\d[\d,\s]*\]\]", rf"(?i)</?(?:{_TAGS})(?:\s[^>\n]{{0,80}})?\s*/?>", r"(?m)^[ \t]*#{1,6}[ \t]+", r"(?m)^[ \t]*[-*+][ \t]+", r"(?m)^[ \t]*[-=_*]{3,}[ \t]*$", r"\\[a-zA-Z]+\*?", r"[`*|~{}$\\]"]
    for s in steps:
        text = f"regexp_replace({text}, '{s}', ' ', 'g')"
    return text


def reading_sql(text: str) -> str:
    """The reading lane of texts without tables, in Latin letters."""
    unified = f"translate(translate(translate({strip_markup_sql(text)}, '’‘ʼ`´', repeat(chr(39), 5)), '“”', '\"\"'), '‐‑‒–—―', '------')"
    for c in ("00AD", "200B", "200C", "200D", "2060", "FEFF"):
        unified = f"replace({unified}, chr({int(c, 16)}), '')"
    return f"trim(regexp_replace(replace(lower(regexp_replace({unified}, '-\\s*\\n\\s*', '', 'g')), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def diplomatic_sql(text: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({text}), '\\s+', ' ', 'g'))"


#: Marks of every kind, composed and decomposed letters, quotes, dashes, hyphenated line ends.
_MARKED = "# Head\n- item\n***\n<b class=\"x\">bold</b> \\emph{x} <|tag|> [[1, 2]] “q” ‘r’ a—b  soft\u00adly exam-\n ple cafe\u0301 "
_MARKED_SQL = "'" + _MARKED.replace("'", "''").replace("\n", "' || chr(10) || '") + "' || text"


@query(f"SELECT doc_id, sha256({diplomatic_sql(_MARKED_SQL)}) AS diplomatic, sha256({reading_sql(f'nfc_normalize({_MARKED_SQL})')}) AS reading, sha256({strip_markup_sql(_MARKED_SQL)}) AS stripped, sha256(array_to_string({X.words_sql(reading_sql(f'nfc_normalize({_MARKED_SQL})'))}, ' ')) AS words FROM documents")
def marked_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes, the markup step and the tokens of texts with all kinds of marks."""
    t = spread(X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(_MARKED), "text").alias("t")))
    n = t.withColumn("n", lanes.normalize("t"))
    return n.select("doc_id", F.sha2("n.diplomatic", 256).alias("diplomatic"), F.sha2("n.reading", 256).alias("reading"), F.sha2(lanes.text_udf(lanes.strip_markup)("t"), 256).alias("stripped"), F.sha2(lanes.text_udf(lambda x: " ".join(lanes.tokens(x)))("t"), 256).alias("words"))


_WORD4 = "string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || ' w x y z', ' ')"


@query(f"WITH w AS (SELECT doc_id, {_WORD4} AS w FROM documents) SELECT doc_id, lower('name no name no ' || w[1] || ' ' || w[2] || ' ' || w[1] || ' ' || w[4] || ' ' || w[3] || ' ' || w[4] || ' ' || w[2]) AS html, lower('name no name no ' || w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4]) AS pipes, lower('name no ' || w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4]) AS plain FROM w")
def regrouped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with repeated headers, column group by column group: HTML with a span, pipes, and one without repeats."""
    w = F.split(F.concat(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), F.lit(" w x y z")), " ")
    a, b, c, d = (w[i] for i in range(4))
    html = F.concat(F.lit('<table class="x"><tr><th>Name</th><th>No</th><th>Name<th>No</tr><tr><td rowspan=2>'), a, F.lit("</td><td>"), b, F.lit("</td><td>"), c, F.lit("</td><td>"), d, F.lit("</td></tr><tr><td>"), a, F.lit(" "), d, F.lit("<td>"), F.lit(""), F.lit("<td>"), b, F.lit("</table>"))
    pipes = F.concat(F.lit("| Name | No | Name | No |\n|---|---|---|:--|\n| "), a, F.lit(" | "), b, F.lit(" | "), c, F.lit(" | "), d, F.lit(" |"))
    plain = F.concat(F.lit("<table><tr><td>Name</td><td>No</td></tr><tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr><tr><td>"), c, F.lit("</td><td>"), d, F.lit("</td></tr></table>"))
    read = lanes.lane_udf("reading")
    return spread(X.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", read(html).alias("html"), read(pipes).alias("pipes"), read(plain).alias("plain"))


@query("SELECT doc_id, replace(replace(strip_accents(text), 'æ', 'ae'), 'œ', 'oe') || 'ae oe' AS folded FROM documents")
def folded_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(X.table(spark, sf_dir, "documents")).select("doc_id", lanes.text_udf(lanes.fold_diacritics)(F.concat("text", F.lit("æ œ"))).alias("folded"))


_LATIN = "len(regexp_extract_all(text, '\\p{Latin}'))"


@query(f"SELECT doc_id, CASE WHEN 40 > {_LATIN} THEN 'cyrillic' WHEN 40 = {_LATIN} THEN 'cyrillic' ELSE 'latin' END AS script, {X.round4_sql(f'(CAST(CASE WHEN 40 >= {_LATIN} THEN 40 ELSE {_LATIN} END AS DOUBLE) / ({_LATIN} + 40 + 3))')} AS match FROM documents")
def dominant_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with forty Cyrillic letters, and with three letters of another script in the output."""
    ref = F.concat(F.col("text"), F.repeat(F.lit("ж"), 40), F.lit("1²"))
    d = spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", script.dominant_script_udf(ref).alias("script"), script.script_match_udf(F.concat(ref, F.lit("カナあ")), ref).alias("match"))


# -- edits that can be counted: characters replaced by, removed or followed by one that no text has ----

_E = "len(regexp_extract_all(text, 'e'))"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_E} ELSE 0 END AS s, CASE WHEN doc_id % 3 = 1 THEN {_E} ELSE 0 END AS d, CASE WHEN doc_id % 3 = 2 THEN {_E} ELSE 0 END AS i, length(text) - CASE WHEN doc_id % 3 < 2 THEN {_E} ELSE 0 END AS h FROM documents")
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("ø"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.replace("text", F.lit("e"), F.lit("eø")))
    return spread(X.table(spark, sf_dir, "documents")).withColumn("c", align.edit_counts_udf("text", out)).select("doc_id", "c.*")
