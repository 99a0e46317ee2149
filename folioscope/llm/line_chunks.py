"""Line deduplication by content-defined chunks, with DataFrame functions only.

A text's lines are hashed; a polynomial hash rolls over the last ``window`` line hashes,
and a chunk ends where it is 0 modulo ``divisor``.  Boundaries depend on nearby lines
only, so they fall alike wherever a passage stands.  Chunks of ``min_lines`` lines or more
that occur more than once, anywhere, are repeats: the first place by (document id, chunk)
keeps its lines, the others lose them.

Chunk hashes are grouped first (pre-aggregated, so a chunk that a third of all documents
share is one row per task); only texts of chunks whose hash repeats are shuffled, and
grouped by their bytes.

Defined results: null reads as the empty text; chunks of white space only are never
repeats; rows equal in id and text count as one place and get equal results; null ids
come first; an input column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm._common import materialize

#: Modulus and base of the rolling hash; products stay within 64 bits.
PRIME = 268_435_399
BASE = 1_000_003


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A name of a projection may be replaced by its expression, which a lambda then computes
    for every element; the variable of a lambda never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _ends(hashes: Column, window: int, divisor: int) -> Column:
    """1-based numbers of the lines that end a chunk."""
    def rolled(i: Column) -> Column:
        first = F.greatest(F.lit(1), i - (window - 1))
        return F.aggregate(F.slice(hashes, first, i - first + 1), F.lit(0).cast("long"), lambda a, h: (a * BASE + h) % PRIME)

    return F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (rolled(i) % divisor == 0) | (i == F.size(hashes)))


def line_hash(line: Column) -> Column:
    """The first 28 bits of the MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunks_of(text: Column, window: int, divisor: int) -> Column:
    """Array of (n lines, text)."""
    def chunk(lines: Column, ends: Column, e: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))))
        return _let(start, lambda s: F.struct((e - s).alias("n"), F.array_join(F.slice(lines, s + 1, e - s), "\n").alias("text")))

    return _let(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda lines: _let(_let(F.transform(lines, line_hash), lambda h: _ends(h, window, divisor)), lambda ends: F.transform(ends, lambda e, k: chunk(lines, ends, e, k))),
    )


def chunk_texts(docs: DataFrame, text: str, window: int, divisor: int) -> DataFrame:
    """Adds ``__chunks``."""
    return docs.withColumn("__chunks", chunks_of(F.col(text), window, divisor))


def _place() -> Column:
    return F.struct("__id", "__row", "__k").alias("place")


def drop_repeated_chunks(docs: DataFrame, window: int = 2, divisor: int = 3, min_lines: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns with ``text`` less its repeats, and n_lines, n_chunks, removed_chunks, removed_lines."""
    added = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    kept = [c for c in docs.columns if c not in added]
    base = docs.select(*kept).withColumn("__row", F.xxhash64(doc_id, text))
    chunked = chunk_texts(base.select("__row", F.col(doc_id).alias("__id"), F.col(text).alias("__text")), "__text", window, divisor)
    several = (F.col("c.n") >= min_lines) & (F.trim(F.translate("c.text", "\n\t\r", "   ")) != "")
    hashed = chunked.select("__row", "__id", F.posexplode("__chunks").alias("__k", "c")).where(several).select("__row", "__id", "__k", F.xxhash64("c.text").alias("h"))
    hashed = materialize(hashed, "chunks")
    again = hashed.groupBy("h").agg(F.min(_place()).alias("a"), F.max(_place()).alias("b")).where("a <> b").select("h")
    # Written first: a join of two plain shuffles can split a chunk that many documents share.
    wanted = hashed.join(materialize(again, "again"), "h").groupBy("__row").agg(F.collect_set("__k").alias("__wanted"))
    # Bytes: only of chunks whose hash repeats.
    texts = chunked.select("__row", "__id", "__chunks").join(wanted, "__row")
    texts = texts.select("__row", "__id", F.explode(_let(F.col("__chunks"), lambda c: F.transform("__wanted", lambda k: F.struct(k.alias("k"), F.element_at(c, k + 1).getField("text").alias("text"))))).alias("w")).select("__row", "__id", F.col("w.k").alias("__k"), F.col("w.text").alias("c"))
    texts = materialize(texts, "repeats")
    first = texts.groupBy("c").agg(F.min(_place()).alias("first"))
    gone = texts.join(materialize(first, "first"), "c").where(_place() != F.col("first")).groupBy("__row").agg(F.collect_set("__k").alias("__gone"))
    out = base.join(gone, "__row", "left")

    def results(chunks: Column, lost: Column) -> Column:
        stay = F.filter(chunks, lambda c, k: ~F.array_contains(lost, k))
        count = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a + c["n"])
        return _let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda c: c["text"]), "\n").alias("text"), count(chunks).alias("n_lines"), F.size(chunks).cast("long").alias("n_chunks"), F.size(lost).cast("long").alias("removed_chunks"), (count(chunks) - count(s)).alias("removed_lines")))

    lost = F.coalesce("__gone", F.array().cast("array<int>"))
    made = _let(chunks_of(F.col(text), window, divisor), lambda c: _let(lost, lambda x: results(c, x)))
    out = out.select(*kept, F.explode(F.array(made)).alias("__made"))  # computed once, whatever reads its fields
    return out.select(*(F.when(F.col(text).isNotNull(), F.col("__made.text")).alias(c) if c == text else F.col(c) for c in kept), *(F.col(f"__made.{c}").alias(c) for c in added))


def _passages(text: Column, min_words: int) -> Column:
    """Array of (a, b, h): lines with words, counted from 0, and the MD5 of the shortest runs of ``min_words`` words from and up to each."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), _n_words(x).alias("n"))), lambda x: x["n"] > 0)

    def count(part: Column) -> Column:
        """How many lines of ``part`` have ``min_words`` words; 0: all have fewer."""
        zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["n"] >= min_words, a).otherwise(F.struct((a["k"] + 1).alias("k"), (a["n"] + x["n"]).alias("n")))
        return F.aggregate(part, zero, step, lambda a: F.when(a["n"] >= min_words, a["k"]).otherwise(0))

    def run(first: Column, k: Column) -> Column:
        return F.struct(first.alias("a"), (first + k - 1).alias("b"))

    def runs(w: Column) -> Column:
        # Every line has a word, so that ``min_words`` lines are enough.
        ahead = F.transform(w, lambda x, i: _let(count(F.slice(w, i + 1, min_words)), lambda k: F.when(k > 0, run(i, k))))
        back = F.transform(w, lambda x, i: _let(count(F.reverse(F.slice(w, F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words))))), lambda k: F.when(k > 0, run(i - k + 1, k))))
        found = F.filter(F.array_distinct(F.concat(ahead, back)), lambda r: r.isNotNull())
        return F.transform(found, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.unhex(F.md5(F.array_join(F.transform(F.slice(w, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: x["line"]), "\n").cast("binary"))).alias("h")))

    return _let(lines, runs)


def _n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "[ \t\r]+", -1), lambda w: w != ""))


def drop_repeated_passages(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns with ``text`` less every run of whole lines of ``min_words`` words that occurs at an earlier place.

    A run's boundaries depend on its own lines only: the shortest runs from its first and
    up to its last lines cover it, wherever it stands.  Lines without words stay and do not
    interrupt a run; a text of nothing but repeats stays as it is.
    """
    base = docs.withColumn("__row", F.xxhash64(doc_id, text))
    found = base.select("__row", F.col(doc_id).alias("__id"), F.explode(_passages(F.col(text), min_words)).alias("r")).select("__row", "__id", F.col("r.a").alias("__k"), F.col("r.b").alias("b"), F.col("r.h").alias("h"))
    found = materialize(found, "passages")
    first = found.groupBy("h").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").select("h", "first")
    gone = found.join(materialize(first, "passages-again"), "h").where(_place() != F.col("first"))
    gone = gone.groupBy("__row").agg(F.collect_set(F.struct(F.col("__k").alias("a"), "b")).alias("__gone"))
    gone = gone.select("__row", F.array_distinct(F.flatten(F.transform("__gone", lambda r: F.sequence(r["a"], r["b"])))).alias("__gone"))
    out = base.join(gone, "__row", "left")

    def less(lost: Column) -> Column:
        lines = F.split(F.col(text), "\n", -1)
        # Where lines with words stand among all lines.
        places = F.filter(F.transform(lines, lambda x, i: F.when(_n_words(x) > 0, i)), lambda i: i.isNotNull())
        at = _let(places, lambda p: F.transform(lost, lambda k: F.element_at(p, k + 1)))
        return _let(at, lambda a: F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(a, i)), "\n"))

    made = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(less(F.col("__gone")))
    made = F.when(F.trim(F.translate(made, "\n\t\r", "   ")) == "", F.col(text)).otherwise(made)
    return out.select(*(made.alias(c) if c == text else F.col(c) for c in docs.columns))
