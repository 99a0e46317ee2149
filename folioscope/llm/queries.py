"""The registered queries of the subpackage: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import suffix_repeats

    got = suffix_repeats.remove_repeats(_table(spark, sf_dir, "documents"), min_len=400)
    # A cut may fall inside a character.
    kept = F.when(F.size("removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("kept").cast("string"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"))


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that op1 removes: each repeat of 400 bytes or more with all its places."""
    from folioscope.llm import suffix_repeats

    return suffix_repeats.repeat_groups(_table(spark, sf_dir, "documents"), min_len=400)


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import line_chunks

    got = line_chunks.drop_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import fingerprints

    return fingerprints.edited_pairs(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import licenses

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licenses.scan(docs, licenses.train(docs))
    return got.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join("families", ",").alias("families"), F.round(F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0)), 6).alias("score"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import warc

    got = warc.archive_and_read(_table(spark, sf_dir, "pages"), min_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import language_id

    docs = _table(spark, sf_dir, "documents")
    got = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import piece_codec

    got = piece_codec.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ["doc_id"])
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import decontaminate

    got = decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import jaccard_join

    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.llm import token_store

    return token_store.write_and_read(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repeats": op1_suffix_repeats,
    "repeat_groups": repeat_groups,
    "op2_line_chunks": op2_line_chunks,
    "op3_fingerprints": op3_fingerprints,
    "op4_licenses": op4_licenses,
    "op5_warc": op5_warc,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontamination": op8_decontamination,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
}

#: A-Z to a-z only, as SQL text.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[p : p + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""

#: Base32 of a SHA-1: eight groups of five hexadecimal digits, four letters each.
_OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST(('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM h
"""

_OP2_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
h AS (SELECT doc_id, w, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS h FROM l),
e AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR
        ((CASE WHEN i > 1 THEN h[CAST(i - 1 AS BIGINT)] % 268435399 * 1000003 ELSE 0 END + h[CAST(i AS BIGINT)]) % 268435399) % 3 = 0) AS e FROM h),
c AS (SELECT doc_id, k - 1 AS k, e[k] - coalesce(e[k - 1], 0) AS n, array_to_string(w[coalesce(e[k - 1], 0) + 1 : e[k]], chr(10)) AS t
      FROM (SELECT doc_id, w, e, unnest(range(1, len(e) + 1)) AS k FROM e)),
r AS (SELECT *, n >= 2 AND trim(translate(t, chr(10) || chr(9) || chr(13), '   ')) <> ''
        AND row_number() OVER (PARTITION BY n >= 2, t ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks,
       CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_chunks": _OP2_SQL,
    "op5_warc": _OP5_SQL,
    "op9_jaccard_join": _OP9_SQL,
    "op8_decontamination": _OP8_SQL,
}
