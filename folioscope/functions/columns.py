"""Column builders that stay in the JVM: rounding, ids, predicates, strata, tokens."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as C

#: Python's white space and word characters as explicit classes (Java's own are ASCII).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
#: The same characters, for trimming: a pattern would be tried at every character of a text.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_TOKEN = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}\x{FFFD}]"
_SPLITTER = 134_217_729.0  # 2^27 + 1


def round4(x: Column) -> Column:
    """Four decimals, rounding the exact binary value, ties to even.

    x * 20000 is exact as the sum of two products (Dekker split), so its comparison with
    the odd number 2k + 1 decides without rounding.
    """
    a = F.abs(x)
    k = F.floor(a * 10000.0).cast("double")
    scaled = a * _SPLITTER
    high = scaled - (scaled - a)
    side = (high * 20000.0 - (k * 2.0 + 1.0)) + (a - high) * 20000.0
    up = F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.pmod(k, F.lit(2.0)))
    return F.when(x.isNotNull(), F.signum(x) * (k + up) / 10000.0)


def rate(numerator: Column, denominator: Column) -> Column:
    """round4(n / d), null for a zero or null denominator."""
    return round4(F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")))


def strip(text: Column) -> Column:
    """Unicode white space off both ends (``trim`` takes U+0020 only)."""
    return F.btrim(text, F.lit(SPACES))


def page_key(value: Column) -> Column:
    """Canonical page id: null for blank, ``7.0`` as ``7``, otherwise the stripped text."""
    text = strip(value.cast("string"))
    whole = F.regexp_extract(text, r"^(-?(?:0|[1-9][0-9]*))\.0+$", 1)
    number = F.when(whole == "-0", "0").otherwise(whole)
    found = F.when(whole != "", number).otherwise(text)
    return F.when((text == "") | (F.lower(text) == "nan"), None).otherwise(found)


def is_truncated(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit(C.TRUNCATED_PREFIX)), F.lit(False))


def is_error(text: Column) -> Column:
    """The error prefix, or a text that is one bracketed error note."""
    return F.coalesce(F.startswith(text, F.lit(C.ERROR_PREFIX)) | text.rlike(rf"(?i)^{SPACE}*\[[^\]]*error[^\]]*\]{SPACE}*$"), F.lit(False))


def stratum(text: Column, threshold: int = C.STRATUM_THRESHOLD) -> Column:
    if isinstance(threshold, bool) or not isinstance(threshold, int) or threshold < 0:
        raise ValueError("the stratum threshold must be a whole number of at least 0")
    return F.when(F.length(F.coalesce(text, F.lit(""))) >= threshold, C.STRATA[0]).otherwise(C.STRATA[1])


def tokens(normalized: Column) -> Column:
    """Word tokens of a normalized text; U+FFFD stays part of its word."""
    return F.filter(F.split(F.regexp_replace(normalized, NOT_TOKEN, " "), f"{SPACE}+", -1), lambda t: t != "")


def token_text(normalized: Column) -> Column:
    """The same tokens as one text with single spaces between."""
    return F.regexp_replace(F.regexp_replace(normalized, NOT_TOKEN, " "), f"{SPACE}+", " ")


def plain_reading(text: Column) -> Column:
    """The reading lane of texts without markup, ligatures or special characters: ASCII case and spaces only."""
    return strip(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def short_code(label: Column) -> Column:
    """``__label__deu_Latn`` as ``de``; unknown codes as ``und``."""
    code = F.split_part(F.regexp_replace(label, "^__label__", ""), F.lit("_"), F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in C.LANGUAGE_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), F.lit("und"))


def iso_name(label: Column) -> Column:
    """``deu_Latn`` as ``German (deu_Latn)``; a label of an unknown code stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in C.LANGUAGE_NAMES.items() for x in pair))
    name = F.try_element_at(names, F.split_part(label, F.lit("_"), F.lit(1)))
    return F.when(name.isNotNull(), F.concat(name, F.lit(" ("), label, F.lit(")"))).otherwise(label)


def slug(text: Column, limit: int = 80) -> Column:
    """File name part: other characters become dashes."""
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    short = F.substring(clean, 1, limit)
    return F.when(short == "", "model").otherwise(short)


def host_matches(url: Column, hosts: list[str]) -> Column:
    """The URL's host is one of ``hosts`` or below one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    found = F.lit(False)
    for h in hosts:
        found = found | (host == h) | F.endswith(host, F.lit("." + h))
    return found


def page_set_fingerprint(df: DataFrame, key: str = "page_key") -> str:
    """SHA-256 of the compact JSON array of all sorted ids; null or repeated ids are errors."""
    total, known, distinct = df.agg(F.count("*"), F.count(key), F.countDistinct(key)).first()
    if known < total:
        raise ValueError("page ids must not be null")
    if distinct < total:
        raise ValueError("page ids must be unique")
    digest = hashlib.sha256(b"[")
    for i, row in enumerate(df.select(key).orderBy(key).toLocalIterator()):
        digest.update((b"," if i else b"") + json.dumps(row[0], ensure_ascii=False).encode())
    digest.update(b"]")
    return digest.hexdigest()


def fingerprint_column(key: Column) -> Column:
    """The same as an aggregate, for groups that fit in one row (see ``group_fingerprints``)."""
    return F.sha2(F.to_json(F.sort_array(F.collect_list(key))), 256)


def group_fingerprints(df: DataFrame, by: str, key: str = "page_key") -> DataFrame:
    """(by, fingerprint) of groups of any size.

    Keys are ranged over tasks in order; each task writes the hash function's input of its
    part of a group as one piece of JSON, and a group's pieces are hashed one after the other,
    so no row holds a group.
    """
    kind = dict(df.dtypes)[by]

    def pieces(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                text = ",".join(json.dumps(x, ensure_ascii=False) for x in keys[at:to])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([text])], ["by", "part", "k", "text"])
                at, k = to, k + 1

    def digests(batches):
        name, running, begun = None, None, False
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                value = batch.column(0)[i].as_py()
                if not begun or value != name:
                    if begun:
                        running.update(b"]")
                        yield pa.RecordBatch.from_arrays([pa.array([name], batch.column(0).type), pa.array([running.hexdigest()])], ["by", "fingerprint"])
                    name, begun, running = value, True, hashlib.sha256(b"[")
                else:
                    running.update(b",")
                running.update(text.encode())
        if begun:
            running.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([name], batch.column(0).type), pa.array([running.hexdigest()])], ["by", "fingerprint"])

    ranged = df.select(F.col(by).alias("by"), F.col(key).cast("string").alias("key")).repartitionByRange("by", "key").sortWithinPartitions("by", "key")
    made = ranged.mapInArrow(pieces, f"by {kind}, part int, k int, text string")
    # The pieces of a group meet in one task, which holds one at a time.
    return made.repartition("by").sortWithinPartitions("by", "part", "k").mapInArrow(digests, f"by {kind}, fingerprint string").withColumnRenamed("by", by)


def stable_json(value: object) -> str:
    """Canonical JSON: sorted keys, compact, unescaped."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def max_diffs(length: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.bround(length * F.lit(share)).cast("int"))


def is_distinctive(text: Column, least: int = 28, most: int = 140, words: int = 5, letters: float = 0.5) -> Column:
    """Long, wordy and alphabetic enough to be looked for in another text."""
    n = F.length(text)
    n_letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return n.between(least, most) & (F.size(tokens(text)) >= words) & (n_letters >= letters * n)


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 101_920, most: int = 1_003_520) -> Column:
    """(height, width) in multiples of ``factor`` with the pixel count within bounds."""
    h = F.greatest(F.lit(factor), F.bround(height / factor).cast("int") * factor)
    w = F.greatest(F.lit(factor), F.bround(width / factor).cast("int") * factor)
    down = F.sqrt(height * width / F.lit(float(most)))
    up = F.sqrt(F.lit(float(least)) / (height * width))
    floor_to = lambda x: F.greatest(F.lit(factor), F.floor(x / factor).cast("int") * factor)
    ceil_to = lambda x: F.ceil(x / factor).cast("int") * factor
    pair = lambda a, b: F.struct(a.alias("height"), b.alias("width"))
    return F.when(h * w > most, pair(floor_to(height / down), floor_to(width / down))).when(h * w < least, pair(ceil_to(height * up), ceil_to(width * up))).otherwise(pair(h, w))


def image_tokens(height: Column, width: Column, variant: str = "rows_28") -> Column:
    """Tokens an image costs: (columns + 1) * rows of 28 pixels, or patches of 32 rounded up."""
    if variant == "rows_28":
        return (F.floor(width / 28) + 1) * F.floor(height / 28)
    return F.ceil(width / 32) * F.ceil(height / 32)
