"""Scripts of letters, told by the words in their Unicode names."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter

from pyspark.sql import types as T

from folioscope.functions import batches

#: Fixed order: the first that occurs in the character's name.
SCRIPTS = ("CYRILLIC", "LATIN", "GREEK", "ARABIC", "HAN", "HEBREW")


@functools.lru_cache(None)
def script_of(character: str) -> str | None:
    """None for what is no letter; ``other`` for letters of further scripts."""
    if not character.isalpha():
        return None
    name = unicodedata.name(character, "")
    return next((s.lower() for s in SCRIPTS if s in name), "other")


def script_counts(text: str) -> Counter:
    found: Counter = Counter()
    for character, n in Counter(text).items():
        if script := script_of(character):
            found[script] += n
    return found


def dominant_script(text: str | None) -> str | None:
    counts = script_counts(text or "")
    counts.pop("other", None)
    return min(counts, key=lambda s: (-counts[s], s)) if counts else None


def script_match(out: str | None, ref: str | None) -> float | None:
    """The share of the output's letters in the reference's script."""
    script, counts = dominant_script(ref), script_counts(out or "")
    return round(counts[script] / counts.total(), 4) if script and counts else None


@batches.text_map(T.StringType())
def dominant_script_udf(texts: list) -> list:
    return [*map(dominant_script, texts)]


@batches.text_map(T.DoubleType())
def script_match_udf(out: list, ref: list) -> list:
    return [script_match(a, b) for a, b in zip(out, ref, strict=True)]
