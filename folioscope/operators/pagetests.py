"""Presence and order tests of page texts, drawn from the pages' own regions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import align, lanes
from folioscope.operators import sampling

# Windows in words, their stride, and what makes a snippet usable.
WINDOWS, STRIDE = (7, 11), 4
LEAST_CHARS, MOST_CHARS, LEAST_WORDS, LETTER_SHARE = 28, 140, 5, 0.5
PRESENCE, INTRA, MIN_GAP, OVERLAP = 3, 2, 3, 0.30
EDIT_SHARE = 0.04


def max_diffs(length: int, share: float) -> int:
    return max(1, round(length * share))


def is_distinctive(text: str) -> bool:
    return LEAST_CHARS <= len(text) <= MOST_CHARS and len(text.split()) >= LEAST_WORDS and sum(map(str.isalpha, text)) >= LETTER_SHARE * len(text)


def snippets(text: str, share: float = EDIT_SHARE) -> list[dict]:
    """Distinct distinctive word windows of a region, in order."""
    words, found = text.split(), {}
    for start in range(0, len(words), STRIDE):
        for size in WINDOWS:
            raw = " ".join(words[start : start + size])
            norm = lanes.reading(raw)
            if start + size <= len(words) and norm not in found and is_distinctive(norm):
                diffs = max_diffs(len(norm), share)
                found[norm] = {"start": start, "raw": raw, "norm": norm, "diffs": diffs, "threshold": round(1 - diffs / len(norm), 4), "context": " ".join(words[max(0, start - 5) : start + size + 5])}
    return [*found.values()]


def distinct_starts(starts: list[int], length: int) -> list[int]:
    """One start per occurrence: those more than half a length after the last kept one."""
    kept: list[int] = []
    for s in sorted(starts):
        if not kept or s - kept[-1] > length * 0.5:
            kept.append(s)
    return kept


def _near(snippet: str, page: str, diffs: int) -> set[int]:
    """Where the snippet would start by the exact occurrences of its diffs + 1 pieces, of which one stands unchanged in any match."""
    size = -(-len(snippet) // (diffs + 1))
    near = set()
    for offset in range(0, len(snippet), size):
        piece, at = snippet[offset : offset + size], -1
        while (at := page.find(piece, at + 1)) >= 0:
            near.add(at - offset)
    return near


def places(snippet: str, page: str, diffs: int, near: set[int] | None = None) -> list[int]:
    """Starts of matches within the edits: only the surroundings of the pieces' exact occurrences are aligned."""
    near = _near(snippet, page, diffs) if near is None else near
    found: list[int] = []
    done = -1
    for start in sorted(near):
        low, high = max(0, start - diffs), min(len(page), start + len(snippet) + 2 * diffs)
        if high > done:
            found += [max(0, low + e - len(snippet)) for e, _ in align.find_within(snippet, page[low:high], diffs)]
            done = high
    return found


def only_place(snippet: str, page: str, diffs: int) -> int | None:
    """Where the snippet occurs, if within the edits it occurs at one place only.

    If its pieces occur in it only, all matches hold a piece in its place, so they end from
    ``diffs`` before its end to ``diffs`` after it; these are one place, and need no alignment.
    """
    near = _near(snippet, page, diffs)
    if len(near) == 1 and 4 * diffs <= len(snippet):
        (at,) = near
        if at >= 0 and page.startswith(snippet, at):
            return max(0, at - diffs)
    starts = distinct_starts(places(snippet, page, diffs, near), len(snippet))
    return starts[0] if len(starts) == 1 else None


def _similar(a: str, b: str) -> float:
    """1 less the share of both texts' characters that are in no longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # zero bits: matched places
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return 2 * (len(a) - free.bit_count()) / (len(a) + len(b)) if a or b else 1.0


def findable(snippet: str, page: str, threshold: float, near: int | None = None) -> bool:
    """Some window of the page as long as the snippet (shorter at the page's ends) is similar to it by ``threshold``.

    Windows round ``near`` are tried first, as that is where a match was found.
    """
    size = len(snippet)
    if threshold <= 1 and snippet in page:
        return True
    if near is not None and any(_similar(snippet, page[s : s + size]) >= threshold for s in range(max(0, near - 3), near + 4)):
        return True
    return any(_similar(snippet, page[max(0, s) : s + size]) >= threshold for s in range(1 - size, len(page)))


def spread(items: list, k: int) -> list:
    return items if len(items) <= k else [items[int(i * (len(items) / k))] for i in range(k)]


def overlap(a: list[float], b: list[float]) -> float:
    """Vertical overlap of two boxes (l, t, r, b) as a share of the smaller height."""
    low = min(a[3] - a[1], b[3] - b[1])
    return max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / low if low > 0 else 0.0


def is_single_column(boxes: list[list[float]], tolerance: float = OVERLAP) -> bool:
    return all(overlap(a, b) <= tolerance for i, a in enumerate(boxes) for b in boxes[:i])


def page_tests(page: str, regions: list[dict], share: float = EDIT_SHARE) -> list[dict]:
    """Rows of one page; regions: label, text and optionally box."""
    norm = lanes.reading(page)
    good: list[tuple[dict, list[tuple[dict, int]]]] = []
    for region in regions:
        places = [(s, at) for s in snippets(region["text"], share) if (at := only_place(s["norm"], norm, s["diffs"])) is not None and findable(s["norm"], norm, s["threshold"], at)]
        if places:
            good.append((region, places))
    rows = []
    for region, s in spread([(r, s) for r, places in good for s, _ in places], PRESENCE):
        rows.append({"test_type": "presence", "basis": "presence", "region_label": region["label"], "target": s["raw"], "target_norm": s["norm"], "target_max_diffs": s["diffs"], "target_threshold": s["threshold"], "context": s["context"]})

    def order(basis: str, a: tuple, b: tuple) -> dict:
        row = {"test_type": "order", "basis": basis}
        for name, (region, (s, at)) in (("before", a), ("after", b)):
            row |= {name: s["raw"], f"{name}_norm": s["norm"], f"{name}_max_diffs": s["diffs"], f"{name}_threshold": s["threshold"], f"{name}_region_label": region["label"], f"{name}_pos": at, f"{name}_context": s["context"]}
        return row

    inside = [(r, p[0], p[-1]) for r, p in good if len(p) > 1 and p[-1][0]["start"] - (p[0][0]["start"] + max(WINDOWS)) >= MIN_GAP and p[0][1] < p[-1][1]]
    rows += [order("intra_region", (r, a), (r, b)) for r, a, b in inside[:INTRA]]
    boxed = sorted(((r, p) for r, p in good if r.get("box")), key=lambda x: x[0]["box"][1])
    if len(boxed) > 1 and is_single_column([r["box"] for r, _ in boxed]):
        (top, a), (low, b) = boxed[0], boxed[-1]
        if top["box"][3] <= low["box"][1] and a[0][1] < b[0][1] and a[0][0]["norm"] != b[0][0]["norm"]:
            rows.append(order("vertical_blocks", (top, a[0]), (low, b[0])))
    return rows


_SIDE = "{0} string, {0}_norm string, {0}_max_diffs int, {0}_threshold double, {0}_region_label string, {0}_pos int, {0}_context string"
SCHEMA = "page_key string, volume string, test_type string, basis string, region_label string, target string, target_norm string, target_max_diffs int, target_threshold double, context string, " + _SIDE.format("before") + ", " + _SIDE.format("after")


def generate(pages: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """Tests of pages (page_key, volume, text, regions JSON); test_id counts them in page order.

    One map over pages; ids come from per-page counts, so no task sees all rows.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at : at + 100] for whole in batches for at in range(0, len(whole), 100)):
            rows = [{"page_key": k, "volume": v, **r} for k, v, t, g in batch[["page_key", "volume", "text", "regions"]].itertuples(index=False) for r in page_tests(t or "", json.loads(g) if g else [], share)]
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in names if n.endswith(("_pos", "max_diffs"))})

    return pages.select("page_key", "volume", "text", "regions").mapInPandas(run, SCHEMA)


def with_ids(tests: DataFrame, prefix: str = "t") -> DataFrame:
    """``test_id``: page key, then the row's number within its page."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("page_key").orderBy("test_type", "basis", F.coalesce("target_norm", "before_norm"), F.coalesce("after_norm", F.lit(""))))
    return tests.withColumn("test_id", F.concat_ws("-", F.lit(prefix), "page_key", number.cast("string")))


def eyeball_report(tests: DataFrame, sample: int, seed: int = 0) -> str:
    """A Markdown sample for reviewers: two thirds presence tests, the rest order tests, the snippet marked once in its context."""
    sizes = {r["test_type"]: r["n"] for r in tests.groupBy("test_type").agg(F.count("*").alias("n")).collect()}
    pages = tests.select("page_key").distinct().count()
    presence = min(sample * 2 // 3, sizes.get("presence", 0))
    wanted = {"presence": presence, "order": min(sample - presence, sizes.get("order", 0))}
    out = ["# Page tests", "", f"{sum(sizes.values())} tests of {pages} pages ({', '.join(f'{n} {k}' for k, n in sorted(sizes.items()))})", ""]
    mark = lambda context, raw: context.replace(raw, f"《{raw}》", 1)
    for kind, n in wanted.items():
        if not n:
            continue
        out += [f"## {kind}", ""]
        drawn = sampling.shuffled(tests.where(F.col("test_type") == kind), seed, "test_id").limit(n)
        for r in drawn.collect():
            if kind == "presence":
                out.append(f"- **{r['page_key']}** {r['volume']} {r['region_label']}: {mark(r['context'], r['target'])}")
            else:
                out.append(f"- **{r['page_key']}** {r['volume']} {r['basis']}: {mark(r['before_context'], r['before'])} | {mark(r['after_context'], r['after'])}")
        out.append("")
    return "\n".join(out)
