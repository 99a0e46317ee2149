"""Corpus preparation: stages over ``documents``, each written and read again.

Every stage works on all that its predecessor kept, and all but the last return the
columns of ``documents``.  Defined results: an empty table passes through; extra columns
are dropped by the first stage; rows with a null id are kept where their text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, jaccard_join, language_id, line_chunks, piece_codec
from folioscope.llm._common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Calibrated probability below which no language is accepted (of four: 0.25 is a guess).
MIN_LANGUAGE_SCORE = 0.4
#: Words of a benchmark window; a document that holds a whole one goes.
WINDOW = 13
#: So does one of whose words a twentieth stand in windows of shorter items.
LEAK_WORDS = 20


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no recognisable language; a missing label is filled in."""
    docs = docs.select(*COLUMNS)
    found = language_id.predict(docs, language_id.fit(docs))
    good = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return good.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated multi-line chunks, then repeated runs of lines of 50 words; a document of nothing but repeated chunks goes."""
    found = line_chunks.drop_repeated_chunks(docs)
    left = F.trim(F.translate("text", "\n\t\r", "   ")) != ""
    kept = materialize(found.where((F.col("removed_chunks") == 0) | left).select(*COLUMNS), "line-chunks")
    return line_chunks.drop_repeated_passages(kept).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the least id stays."""
    return jaccard_join.drop_near_duplicates(docs, k=5, num=80, den=100).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ``WINDOW`` benchmark words, or of which a twentieth is hit; short items are cut from the others."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW)
    whole = F.exists("hits", lambda h: h["end"] - h["start"] >= WINDOW)
    kept = found.where((F.col("n_hit") == 0) | (~whole & (LEAK_WORDS * F.col("n_hit") < F.col("n_words"))))
    n_chars = F.when(F.col("n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return decontaminate.cut_hits(kept).withColumn("n_chars", n_chars).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every kept text, and the text that they decode to."""
    import public_tokenizers

    got = piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source"])
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece", encode_pieces),
]

#: The language model and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
