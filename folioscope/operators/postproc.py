"""Per-model text transforms and their registry.

A chain is a tuple of named functions.  Chains of plain expressions run as columns in the
JVM; the others run in one Arrow pass that dispatches on the model.  A failing transform
leaves no text: the row is sealed with an error note that names it.
"""

from __future__ import annotations

import html as html_module
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions import batches, columns

# Markup shapes that models emit.
FRONT_MATTER = re.compile(r"^---\s*\n(.*?)\n---\s*(?:\n(.*))?$", re.DOTALL)
EDGE_SPECIALS = ("<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>")
DET_HEADER = re.compile(r"<\|det\|>([^<\s]+)(?:\s*\[[^\]]*\])?\s*<\|/det\|>(.*)", re.DOTALL)
DET_SPAN = re.compile(r"<\|det\|>.*?<\|/det\|>", re.DOTALL)
REF_SPAN = re.compile(r"<\|ref\|>.*?<\|/ref\|>", re.DOTALL)
REF_MARK = re.compile(r"<\|/?ref\|>")
DET_MARK = re.compile(r"<\|/?det\|>")
ORPHAN_CLOSE = re.compile(r"(?:^|\n)\s*[A-Za-z_-]+\s*\[[0-9,\s]+\]\s*<\|/det\|>")
ORPHAN_OPEN = re.compile(r"<\|det\|>\s*[A-Za-z_-]+\s*\[[0-9,\s]+\]\s*(?!<\|/det\|>)")
LEADING_HEADER = re.compile(r"^[A-Za-z_-]+\s*\[[0-9,\s]+\]")
RESIDUE = re.compile(r"<\s*[|｜][^|｜]{0,40}[|｜]\s*>")
UNUSED_TOKEN = re.compile(r">>UNUSED_\d+<<")
IMAGE_LINK = re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)")
EMPHASIS = re.compile(r"(?<![\w_])_(?=\S)([^_\n]+?)(?<=\S)_(?![\w_])")
BBOX_BLOCK = '<img src="images/bbox_'
REPEAT_FLOOR = 2000


def identity(text: str) -> str:
    return text


def strip_outer_whitespace(text: str) -> str:
    return text.strip()


def require_non_empty(text: str) -> str:
    """A recorded decision without effect: empty pages are the scorer's business."""
    return text


def drop_bbox_blocks(text: str) -> str:
    return "\n\n".join(b for b in text.split("\n\n") if not b.strip().startswith(BBOX_BLOCK))


def clean_repeated_substrings(text: str, min_repeats: int = 10) -> str:
    """One copy of the shortest suffix that ends the text ten times or more; short texts stay.

    A suffix of length p repeats r times at the end iff the last (r - 1) p characters equal
    those p earlier.
    """
    n = len(text)
    if n < REPEAT_FLOOR:
        return text
    for period in range(2, n // min_repeats):
        if text[n - (min_repeats - 1) * period :] == text[n - min_repeats * period : n - period]:
            end = n - min_repeats * period
            while end >= period and text[end - period : end] == text[n - period :]:
                end -= period
            return text[: end + period]
    return text


def unwrap_fence(text: str) -> str:
    """The inside of a reply that is one code fence as a whole."""
    parts = text.split("```")
    if len(parts) != 3 or parts[0] or parts[2]:
        return text
    first, newline, rest = parts[1].partition("\n")
    tagged = not first.strip() or first.strip().isalpha()
    return (rest if tagged else parts[1]).strip()


def nuextract3_strip_thinking(text: str) -> str:
    before, mark, after = text.partition("</think>")
    return (after if mark and "<think>" in text else text).strip()


def qianfan_strip_thinking(text: str) -> str:
    _, mark, after = text.partition("</think>")
    if mark:
        return after.strip()
    if "<think>" in text:
        raise ValueError("reasoning without an end")
    return text


def drop_front_matter(text: str) -> str:
    found = FRONT_MATTER.match(text)
    return text if not found else found[2] or ""


def strip_edge_specials(text: str) -> str:
    for mark in EDGE_SPECIALS:
        text = text.removeprefix(mark).removesuffix(mark)
    return text.strip()


def _no_residue(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    if found := RESIDUE.findall(text):
        raise ValueError(f"markup is left: {found[:5]}")
    return text


def remove_det(text: str) -> str:
    """Blocks under their detection headers, headers gone; image blocks' headers start nothing."""
    blocks: list[list[str]] = []
    for line in filter(None, map(str.rstrip, text.splitlines())):
        header = DET_HEADER.match(line)
        if header is None:
            if not blocks:
                blocks.append([])
            blocks[-1].append(line)
        elif header[1].strip() != "image":
            blocks.append([c] if (c := header[2].strip()) else [])
    return "\n\n".join("\n".join(b) for b in blocks).strip()


def unlimited_ocr_to_markdown(text: str) -> str:
    text = remove_det(ORPHAN_CLOSE.sub("\n", text))
    for pattern in (DET_SPAN, ORPHAN_OPEN, DET_MARK, REF_MARK):
        text = pattern.sub("", text)
    return _no_residue(LEADING_HEADER.sub("", text.strip()))


def deepseek_strip_grounding(text: str) -> str:
    for pattern in (REF_SPAN, DET_SPAN, REF_MARK):
        text = pattern.sub("", text)
    return _no_residue(text)


def falcon_strip_unused_tokens(text: str) -> str:
    return UNUSED_TOKEN.sub("", text)


def oxr_drop_image_links(text: str) -> str:
    return IMAGE_LINK.sub("", text)


def strip_underscore_emphasis(text: str) -> str:
    return EMPHASIS.sub(r"\1", text)


class Unavailable(RuntimeError):
    """A vendor converter that is not installed here."""


#: Converters that come with a vendor's package; register one to use its models.
CONVERTERS: dict[str, Callable[[str], str]] = {}


def _external(name: str) -> Callable[[str], str]:
    def run(text: str) -> str:
        if name not in CONVERTERS:
            raise Unavailable(f"no converter is registered for {name}")
        return CONVERTERS[name](text)

    run.__name__ = name
    return run


smoldocling_doctags_to_markdown = _external("smoldocling_doctags_to_markdown")
nemotron_parse_to_markdown = _external("nemotron_parse_to_markdown")


def unlimited_ocr2_to_markdown(text: str) -> str:
    from folioscope.operators import layout

    made = re.sub(r"\n{3,}", "\n\n", IMAGE_LINK.sub("", layout.convert(text))).strip()
    if left := layout.residue(made):
        raise ValueError(f"block marks are left: {left[:5]}")
    return made


class _Markdown(HTMLParser):
    """HTML of layout blocks as Markdown: headings, lists, emphasis, math; tables stay HTML."""

    BLOCKS = frozenset("p div section article blockquote figure figcaption header footer".split())
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~", "sub": "<sub>", "sup": "<sup>"}
    VOID = frozenset("br hr img input col wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []  # [kind, items so far]
        self.table = 0
        self.math: list[bool] = []
        self.pre = 0
        self.links: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag == "table" or self.table:
            if tag == "table":
                if not self.table:
                    self.out.append("\n\n")
                self.table += 1
            self.out.append(self.get_starttag_text())
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, int(values.get("start") or 1) - 1 if tag == "ol" and str(values.get("start") or 1).isdigit() else 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            numbered = bool(self.lists) and self.lists[-1][0] == "ol"
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if numbered else "- "))
        elif tag == "math":
            block = values.get("display") == "block"
            self.math.append(block)
            self.out.append("\n$$" if block else " $")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append((values.get("href") or "", len(self.out)))
        elif tag == "img" and values.get("src"):
            self.out.append(f"![{values.get('alt') or ''}]({values['src']})")
        elif tag in self.MARKS and not self.math:
            self.out.append(self.MARKS[tag])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID and not self.table:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.table:
            self.out.append(f"</{tag}>")
            if tag == "table":
                self.table -= 1
                if not self.table:
                    self.out.append("\n\n")
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCKS:
            self.out.append("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag == "math" and self.math:
            self.out.append("$$\n" if self.math.pop() else "$ ")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            inner = re.sub(r"([\[\]()])", r"\\\1", "".join(self.out[at:]))
            self.out[at:] = [f"[{inner}]({href})" if href else inner]
        elif tag in self.MARKS and not self.math:
            self.out.append({"sub": "</sub>", "sup": "</sup>"}.get(tag, self.MARKS[tag]).replace("</sub>", "<sub>").replace("</sup>", "<sup>"))

    def handle_data(self, data: str) -> None:
        if self.table:
            self.out.append(html_module.escape(data, quote=False))
        elif self.math or self.pre:
            self.out.append(data.strip() if self.math else data)
        else:
            data = re.sub(r"\s+", " ", data)
            self.out.append(re.sub(r"([*_$])", r"\\\1", data))

    def text(self) -> str:
        joined = "".join(self.out)
        joined = re.sub(r"[ \t]+(?=\n\n)", "", joined)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n\n[ \t]+(?!- |\d)", "\n\n", joined)).strip()


def html_to_markdown(text: str) -> str:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    return parser.text()


class _Blocks(HTMLParser):
    """Top-level divs with their labels and inner HTML."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str | None, list[str]]] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "div":
            self.depth += 1
            if self.depth == 1:
                self.found.append((dict(attrs).get("data-label"), []))
                return
        self._keep(self.get_starttag_text())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._keep(self.get_starttag_text())

    def handle_endtag(self, tag: str) -> None:
        if tag == "div":
            self.depth = max(0, self.depth - 1)
            if not self.depth:
                return
        self._keep(f"</{tag}>")

    def _keep(self, piece: str | None) -> None:
        if self.depth and piece:
            self.found[-1][1].append(piece)

    def handle_data(self, data: str) -> None:
        self._keep(data)

    def handle_entityref(self, name: str) -> None:
        self._keep(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._keep(f"&#{name};")


_NO_SOURCE = re.compile(r"<img\b(?![^>]*\bsrc\s*=\s*[\"']?[^\"'\s>])[^>]*>", re.IGNORECASE)


def chandra_html_to_markdown(text: str, include_headers_footers: bool = False) -> str:
    """Labelled layout blocks as Markdown; figures, blank pages and (by default) furniture go."""
    skip = {"Blank-Page", "Image", "Figure"} | (set() if include_headers_footers else {"Page-Header", "Page-Footer"})
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    made = []
    for label, pieces in parser.found:
        if label in skip:
            continue
        inner = _NO_SOURCE.sub("", "".join(pieces))
        made.append(f"<p>{inner.strip()}</p>" if label == "Text" and not re.search("<.+>", inner.strip()) else inner)
    return html_to_markdown("".join(made))


def surya_blocks_to_markdown(text: str) -> str:
    """Page blocks (JSON) in reading order, furniture kept, through the same conversion."""
    made = []
    for block in sorted(json.loads(text), key=lambda b: b["reading_order"]):
        if block["skipped"] or not block["html"]:
            continue
        inner = block["html"] if re.search("<.+>", block["html"].strip()) else f"<p>{block['html'].strip()}</p>"
        made.append(f'<div data-label="{html_module.escape(block["raw_label"] or block["label"], quote=True)}">{inner}</div>')
    return chandra_html_to_markdown("".join(made), include_headers_footers=True) if made else ""


# The chain of each model; a model that is not here is refused.
REGISTRY: dict[str, tuple[Callable[[str], str], ...]] = {
    "deepseek-ai/DeepSeek-OCR": (strip_outer_whitespace, deepseek_strip_grounding, require_non_empty),
    "deepseek-ai/DeepSeek-OCR-2": (strip_outer_whitespace, deepseek_strip_grounding),
    "tiiuae/Falcon-OCR": (strip_outer_whitespace, falcon_strip_unused_tokens),
    "rednote-hilab/dots.mocr": (strip_outer_whitespace, require_non_empty),
    "rednote-hilab/dots.ocr": (strip_outer_whitespace,),
    "google/gemma-4-12B-it": (strip_outer_whitespace, unwrap_fence, require_non_empty),
    "zai-org/GLM-OCR": (strip_outer_whitespace, require_non_empty),
    "tencent/HunyuanOCR": (strip_outer_whitespace, clean_repeated_substrings),
    "kraken/PP-OCRv6-medium": (strip_outer_whitespace,),
    "lightonai/LightOnOCR-2-1B": (strip_outer_whitespace,),
    "datalab-to/indra-ocr": (strip_outer_whitespace,),
    "datalab-to/chandra-ocr-2": (strip_outer_whitespace, chandra_html_to_markdown),
    "datalab-to/surya-ocr-2.5": (strip_outer_whitespace, surya_blocks_to_markdown),
    "lightonai/LightOnOCR-3-4B": (strip_outer_whitespace,),
    "lightonai/LightOnOCR-3-0.8B": (strip_outer_whitespace,),
    "nvidia/Nemotron-3.5-Parse": (strip_outer_whitespace, nemotron_parse_to_markdown, strip_underscore_emphasis),
    "numind/NuExtract3": (nuextract3_strip_thinking,),
    "allenai/olmOCR-2-7B-1025-FP8": (strip_outer_whitespace, drop_front_matter),
    "ATH-MaaS/OvisOCR2": (strip_outer_whitespace, drop_bbox_blocks),
    "ATH-MaaS/OvisOCR3": (strip_outer_whitespace, drop_bbox_blocks),
    "SoMarkAI/OXR-1.0": (strip_outer_whitespace, oxr_drop_image_links),
    "openbmb/MiniCPM-OCR-1.0": (strip_outer_whitespace, oxr_drop_image_links),
    "PaddlePaddle/PaddleOCR-VL-1.6": (strip_outer_whitespace,),
    "baidu/Qianfan-OCR": (strip_outer_whitespace, qianfan_strip_thinking, require_non_empty),
    "Qwen/Qwen3.5-9B": (strip_outer_whitespace, unwrap_fence, require_non_empty),
    "ds4sd/SmolDocling-256M-preview": (strip_outer_whitespace, smoldocling_doctags_to_markdown),
    "baidu/Unlimited-OCR": (strip_outer_whitespace, strip_edge_specials, unlimited_ocr_to_markdown),
    "baidu/Unlimited-OCR-2": (strip_outer_whitespace, unlimited_ocr2_to_markdown),
}
EXTRACTION_ONLY = {"LiquidAI/LFM2.5-VL-1.6B-Extract": "it stores extracted fields, not text"}


def resolve(model: str, identity_for_unregistered: bool = False) -> tuple[Callable[[str], str], ...]:
    if model in EXTRACTION_ONLY:
        raise ValueError(f"{model}: {EXTRACTION_ONLY[model]}")
    if model not in REGISTRY and not identity_for_unregistered:
        raise ValueError(f"{model} has no registered transforms")
    return REGISTRY.get(model) or (identity,)


def apply(text: str, chain: tuple[Callable[[str], str], ...]) -> tuple[str | None, list[str], str | None]:
    """(text, names of the transforms applied, error)."""
    done: list[str] = []
    for step in chain:
        try:
            text = step(text)
        except Exception as e:  # any failure of a page becomes that page's error note
            return None, done, f"{step.__name__}: {type(e).__name__}: {e}"
        done.append(step.__name__)
    return text, done, None


#: The transforms that plain expressions can do.
_EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda c: c,
    "strip_outer_whitespace": columns.strip,
    "require_non_empty": lambda c: c,
    "drop_bbox_blocks": lambda c: F.array_join(F.filter(F.split(c, "\n\n", -1), lambda b: ~F.startswith(columns.strip(b), F.lit(BBOX_BLOCK))), "\n\n"),
    "falcon_strip_unused_tokens": lambda c: F.regexp_replace(c, r">>UNUSED_\d+<<", ""),
    "oxr_drop_image_links": lambda c: F.regexp_replace(c, r"!\[[^\]\n]*\]\([^)\n]*\)", ""),
    "nuextract3_strip_thinking": lambda c: columns.strip(F.when(F.contains(c, F.lit("<think>")) & F.contains(c, F.lit("</think>")), F.substring(c, F.locate("</think>", c) + 8, F.length(c))).otherwise(c)),
}


def expression(chain: tuple[Callable[[str], str], ...], text: Column) -> Column | None:
    """The chain as one column, or None if a step needs Python."""
    for step in chain:
        if step.__name__ not in _EXPRESSIONS:
            return None
        text = _EXPRESSIONS[step.__name__](text)
    return text


def column(step: Callable[[str], str]):
    """One transform as a column function; a failure is an error of the query."""
    return batches.text_map(T.StringType())(lambda texts: [*map(step, texts)])


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def normalize_frame(rows: DataFrame, raw: str = "raw", out: str = "markdown", model: str = "model", identity_for_unregistered: bool = False) -> DataFrame:
    """Adds ``out``, transforms_applied, postproc_version, normalize_error.

    Sealed error rows pass unchanged with no transforms.  Models are few, so their list is
    read first and unknown ones refused; models whose chains are expressions never leave the JVM.
    """
    if raw == out:
        raise ValueError("the raw text must not be overwritten")
    missing = [c for c in (raw, model) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if dict(rows.dtypes)[raw] != "string":
        raise ValueError("raw cells must be strings")
    # Models and empty cells are found in one pass.
    seen = rows.groupBy(model).agg(F.max(F.col(raw).isNull()).alias("null")).collect()
    names = [r[0] for r in seen]
    if not names:
        raise ValueError("there are no rows")
    if any(n is None or not str(n).strip() for n in names):
        raise ValueError("a model id is blank")
    if any(r["null"] for r in seen):
        raise ValueError("a raw cell is null")
    chains = {n: resolve(n, identity_for_unregistered) for n in names}
    plain = {n: c for n, c in chains.items() if expression(c, F.lit("")) is not None}
    sealed = F.startswith(F.col(raw), F.lit(C.ERROR_PREFIX))

    def finish(df: DataFrame, result: Column) -> DataFrame:
        df = df.withColumn("__r", result)
        text = F.when(sealed, F.col(raw)).when(F.col("__r.error").isNotNull(), F.concat(F.lit(C.ERROR_PREFIX), "__r.error")).otherwise(F.col("__r.text"))
        return df.withColumns({out: text, "transforms_applied": F.when(sealed, F.array().cast("array<string>")).otherwise(F.col("__r.applied")), "postproc_version": F.lit(C.POSTPROC_VERSION), "normalize_error": F.when(~sealed, F.col("__r.error"))}).drop("__r")

    @batches.text_map(_RESULT)
    def in_python(texts: list, models: list) -> list:
        made = ((None, [], None) if t.startswith(C.ERROR_PREFIX) else apply(t, chains[m]) for t, m in zip(texts, models, strict=True))
        return [dict(zip(("text", "applied", "error"), row, strict=True)) for row in made]

    by_model = None
    for name, chain in sorted(plain.items()):
        value = F.struct(expression(chain, F.col(raw)).alias("text"), F.array(*(F.lit(f.__name__) for f in chain)).alias("applied"), F.lit(None).cast("string").alias("error"))
        by_model = F.when(F.col(model) == name, value) if by_model is None else by_model.when(F.col(model) == name, value)
    parts = []
    if by_model is not None:
        parts.append(finish(rows.where(F.col(model).isin(*plain)), by_model))
    if len(plain) < len(chains):
        parts.append(finish(rows.where(F.col(model).isin(*(set(chains) - set(plain)))), in_python(raw, model)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
