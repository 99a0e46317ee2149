"""Scorecards: one row of axes and supports per (model, page).

Outputs are joined with the ground truth on the canonical page id; every text is
normalized and aligned once, in one Arrow pass that returns all counts of a page; rates
are columns over those counts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions import align, batches, columns, lanes, script
from folioscope.operators import multiset, validate
from folioscope.sources.shared import spread


@dataclass(frozen=True)
class Axis:
    """A metric: adding one to ``AXES`` adds its column to every scorecard."""

    name: str
    kind: str
    lane: str
    higher_is_better: bool
    compute: Callable[[], Column]
    what: str
    why: str
    caveats: str = ""


def _cer(key: str) -> Column:
    s, d, i, h = (F.col(f"{key}_{x}") for x in "sdih")
    return columns.rate(s + d + i, s + d + h)


def _share(pair: int) -> Column:
    return columns.rate(*(F.col(c) for c in C.SUPPORT_PAIRS[pair]))


AXES = [
    Axis("recall", "coverage", "reading", True, lambda: _share(0), "share of reference words found in the output, counted", "omissions"),
    Axis("over_extraction", "coverage", "reading", False, lambda: F.when(F.col("over_extraction_output") == 0, F.lit(0.0)).otherwise(_share(1)), "share of output words that the page does not account for", "inventions and loops", "0 for an empty output"),
    Axis("cer_diplomatic", "fidelity", "diplomatic", False, lambda: _cer("cer_body_dip"), "edits per legible reference character, case and glyphs kept", "faithful transcription"),
    Axis("cer_reading", "fidelity", "reading", False, lambda: _cer("cer_body_read"), "edits per legible reference character after folding", "readable transcription", "may exceed 1"),
    Axis("script_match", "script", "raw", True, lambda: F.col("script_match_raw"), "share of output letters in the page's script", "wrong alphabet"),
    Axis("furniture_global_token_recall", "coverage", "reading", True, lambda: _share(2), "share of running heads and page numbers found anywhere in the output", "dropped furniture"),
    Axis("region_global_token_recall", "coverage", "reading", True, lambda: F.col("regions"), "the same per region label", "dropped regions", "a JSON object by label"),
]


def axis_catalogue() -> str:
    """The axes as Markdown, grouped by kind in the order of their first axis."""
    out = ["# Axes", ""]
    for kind in dict.fromkeys(a.kind for a in AXES):
        out += [f"## {kind}", "", "| axis | lane | better | what | why | caveats |", "|---|---|---|---|---|---|"]
        out += [f"| {a.name} | {a.lane} | {'higher' if a.higher_is_better else 'lower'} | {a.what} | {a.why} | {a.caveats or '-'} |" for a in AXES if a.kind == kind]
        out.append("")
    return "\n".join(out)


_RAW = [f"{k}_{x}" for k in C.COUNT_KEYS for x in "sdih"] + [c for pair in C.SUPPORT_PAIRS for c in pair]
_PAGE = T.StructType([*(T.StructField(c, T.LongType()) for c in _RAW), T.StructField("gt_script", T.StringType()), T.StructField("script_match_raw", T.DoubleType()), T.StructField("regions", T.StringType())])


#: Rows of a page follow each other after the join, so its reference texts are normalized once.
_diplomatic, _reading = lru_cache(64)(lanes.diplomatic), lru_cache(64)(lanes.reading)


@lru_cache(64)
def _token_counts(text: str | None) -> Counter:
    return Counter(lanes.words(_reading(text)))


def page_counts(ref: str, body: str | None, furniture: str | None, regions: list | None, out: str) -> dict:
    """All counts of one page; body defaults to the whole text."""
    body = ref if body is None else body
    made: dict[str, object] = {}
    forms = {"dip": _diplomatic, "read": _reading}
    out_forms = {k: f(out) for k, f in forms.items()}
    for part, text in (("body", body), ("full", ref)):
        for lane, form in forms.items():
            if part == "full" and ref == body:
                counts = [made[f"cer_body_{lane}_{x}"] for x in "sdih"]
            else:
                counts = align.edit_counts(form(text), out_forms[lane])
            made |= {f"cer_{part}_{lane}_{x}": n for x, n in zip("sdih", counts, strict=True)}
    body_words, all_words, out_words = (_token_counts(t) for t in (body, ref, out))
    furniture_words = multiset.legible(_token_counts(furniture))
    made["recall_matched"], made["recall_reference"] = multiset.recall_support(multiset.legible(body_words), out_words)
    made["over_extraction_extra"], made["over_extraction_output"] = multiset.extra_support(all_words, out_words)
    made["furniture_global_token_recall_matched"], made["furniture_global_token_recall_reference"] = multiset.recall_support(furniture_words, out_words)
    made["gt_script"], made["script_match_raw"] = script.dominant_script(ref), script.script_match(out, ref)
    labels: dict[str, Counter] = {}
    for r in regions or ():
        labels.setdefault(r["label"] or "?", Counter()).update(multiset.legible(_token_counts(r["text"])))
    found = {}
    for label in sorted(labels):
        matched, reference = multiset.recall_support(labels[label], out_words)
        if reference:
            found[label] = {"rate": round(matched / reference, 4), "matched": matched, "reference": reference}
    made["regions"] = json.dumps(found)
    return made


@batches.text_map(_PAGE)
def _count_pages(*texts: list) -> list:
    return [page_counts(ref or "", body, furniture, json.loads(regions) if regions else None, out or "") for ref, body, furniture, regions, out in zip(*texts, strict=True)]


#: Ground truth: page_key, volume, language, text, and optionally body_text, furniture_text, regions (JSON).
def join_outputs(outputs: DataFrame, truth: DataFrame, text: str = "text") -> DataFrame:
    """Strict N:1 join; see ``validate.check_join`` for what it presupposes.

    Ground truth is broadcast only where Spark's own size statistics allow it.  Rows of a page
    come one after the other, so that its reference is normalized once.
    """
    optional = {c: (F.col(c) if c in truth.columns else F.lit(None).cast("string")) for c in ("body_text", "furniture_text", "regions")}
    gt = truth.select("page_key", "volume", "language", F.col("text").alias("gt_text"), *(v.alias(c) for c, v in optional.items()))
    out = outputs.select("page_key", "model", F.col(text).alias("out_text"))
    return spread(out, "page_key").join(spread(gt, "page_key"), "page_key").sortWithinPartitions("page_key")


def score_pages(joined: DataFrame, threshold: int = C.STRATUM_THRESHOLD, postproc_version: str = C.NO_POSTPROC) -> DataFrame:
    """Scorecard rows of joined pages; outputs that are error notes count as empty."""
    error = columns.is_error(F.col("out_text"))
    out = joined.withColumns({"error": error, "truncated": columns.is_truncated(F.col("out_text"))})
    out = out.withColumn("counts", _count_pages("gt_text", "body_text", "furniture_text", "regions", F.when(F.col("error"), "").otherwise(F.col("out_text"))))
    out = out.select("model", F.col("page_key").alias("page_id"), "volume", "language", "error", "truncated", columns.stratum(F.col("gt_text"), threshold).alias("sample_stratum"), F.lit(threshold).alias("sample_stratum_threshold"), "counts.*")
    out = out.select("*", *(a.compute().alias(a.name) for a in AXES)).drop("script_match_raw", "regions")
    return out.withColumns({"norm_version": F.lit(C.NORM_VERSION), "scorer_version": F.lit(C.SCORER_VERSION), "scorecard_schema_version": F.lit(C.SCORECARD_SCHEMA_VERSION), "postproc_version": F.lit(postproc_version), "score_provenance": F.lit(columns.stable_json(score_provenance()))})


def score_provenance() -> dict:
    return {"norm_version": C.NORM_VERSION, "aligner": C.ALIGNER, "lanes": {"diplomatic": "NFC, white space", "reading": "tables, markup, NFKC, quotes, hyphens, case"}, "grapheme_mode": "codepoint", "word_boundary": "white space after punctuation", "illegible_marker": "U+FFFD matches anything"}


def benchmark_provenance(truth: DataFrame, dataset_id: str, requested: str | None, resolved: str | None, threshold: int = C.STRATUM_THRESHOLD) -> dict:
    """What a ground-truth table is: page count, strata and page set fingerprint."""
    strata = dict.fromkeys(C.STRATA, 0) | {r["s"]: r["n"] for r in truth.groupBy(columns.stratum(F.col("text"), threshold).alias("s")).agg(F.count("*").alias("n")).collect()}
    if "sample_stratum" in truth.columns:
        drift = truth.where(F.col("sample_stratum").isNotNull() & (F.col("sample_stratum") != columns.stratum(F.col("text"), threshold)))
        if not drift.isEmpty():
            raise ValueError("declared sample strata differ from the texts' own")
    found = {}
    if sampler := [c for c in C.SAMPLER_FIELDS if c in truth.columns]:
        if len(sampler) < len(C.SAMPLER_FIELDS):
            raise ValueError(f"sampler provenance lacks {', '.join(c for c in C.SAMPLER_FIELDS if c not in sampler)}")
        rows = truth.select(*sampler).distinct().limit(2).collect()
        if len(rows) != 1:
            raise ValueError("sampler provenance must be uniform")
        found = {"sampler_provenance": rows[0].asDict() | {"sample_stratum_threshold": threshold}}
        validate.check_sampler(found["sampler_provenance"], threshold)
    fingerprint = columns.page_set_fingerprint(truth)
    return {"dataset_id": dataset_id, "requested_revision": requested, "resolved_revision": resolved or f"local:{fingerprint}", "dataset_fingerprint": f"local:{fingerprint}", "expected_page_count": sum(strata.values()), "full_page_set_fingerprint": fingerprint, "sample_stratum_threshold": threshold, "expected_stratum_counts": dict(sorted(strata.items()))} | found
