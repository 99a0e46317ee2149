"""Agreement of two sources' texts for the same pages, and re-scoring by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import align, columns
from folioscope.sources.shared import spread


def stem(path: Column, extension: str = ".xml") -> Column:
    """File name without directory and extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), extension.replace(".", r"\.") + "$", "")


def agreement(a: Column, b: Column, in_jvm: bool = True) -> Column:
    """1 - CER, at least 0, four decimals; the distance comes from the JVM where nothing is illegible."""
    if in_jvm:
        cer = F.try_divide(F.levenshtein(a, b).cast("double"), F.length(a))
    else:
        c = align.edit_counts_udf(a, b)
        cer = F.try_divide((c["s"] + c["d"] + c["i"]).cast("double"), c["s"] + c["d"] + c["h"])
    # Of a rate with four decimals the rest to 1 has four too: counted in ten thousandths.
    parts = F.round(columns.round4(cer) * 10000.0)
    return (10000.0 - F.when(parts > 10000.0, 10000.0).otherwise(parts)) / 10000.0


def match(left: DataFrame, right: DataFrame, path: str = "xml_path", key: str = "gt_page_id") -> DataFrame:
    """Left rows with the right text of the same page, null where there is none."""
    return spread(left.withColumn(key, stem(F.col(path))), key).join(spread(right.select(key, F.col("text").alias("other_text")), key), key, "left")


def summary(scores: DataFrame, column: str = "agreement") -> DataFrame:
    """One row: n, median, mean, p10 (the value at rank n div 10), counts of at least .95 and .85."""
    ranked = scores.where(F.col(column).isNotNull())
    n = ranked.agg(F.count("*").alias("n"))
    # The value at a rank, without sorting into one task: counts per distinct value (four decimals), added up.
    values = ranked.groupBy(column).agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    upto = values.withColumn("upto", F.sum("k").over(Window.orderBy(column)))  # at most 10,001 rows
    p10 = upto.join(F.broadcast(n)).where("upto > n div 10").agg(F.min(column).alias("p10"))
    stats = ranked.agg(F.count("*").alias("n"), columns.round4(F.median(column)).alias("median"), columns.round4(F.avg(F.col(column).cast("decimal(18,4)")).cast("double")).alias("mean"), F.count_if(F.col(column) >= 0.95).alias("at_least_95"), F.count_if(F.col(column) >= 0.85).alias("at_least_85"))
    return stats.join(p10)


def lowest(scores: DataFrame, k: int = 15, below: float = 0.85, column: str = "agreement", key: str = "page_key") -> DataFrame:
    return scores.where(F.col(column) < below).orderBy(column, key).limit(k)


def by_content(rows: DataFrame, sources: DataFrame, digest: str = "source_sha256", key: str = "page_id") -> DataFrame:
    """Rows with the text of the source whose hash they recorded; a same-named source never stands in."""
    return rows.join(sources.select(digest, key, F.col("text").alias("source_text")), [digest, key], "left")
