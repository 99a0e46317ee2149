"""Text lanes: the diplomatic and the reading form of a text, one Arrow pass for both.

``normalize`` handles a batch of texts at a time and gives both lanes at once; it exists
because Spark has no Unicode normalization or case folding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import types as T

from folioscope.functions import batches

# Characters that lanes unify, and the names and shapes of markup.
APOSTROPHES = "'’‘ʼ`´"
DOUBLE_QUOTES = "“”"
HYPHENS = "‐‑‒–—―"
INVISIBLE = "­​‌‍⁠﻿"
TAG_NAMES = ("a", "b", "big", "blockquote", "br", "caption", "center", "code", "col", "colgroup", "div", "em", "figcaption", "figure", "font", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "li", "mark", "ol", "p", "pre", "s", "small", "span", "strike", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "tt", "u", "ul")
#: Shapes of markup in the order of their removal, each with what a text that has it contains.
_MARKUP = (
    (("<|",), re.compile(r"<\|/?[A-Za-z0-9_]+\|>")),
    (("[[",), re.compile(r"\[\[\s*\d[\d,\s]*\]\]")),
    (("<",), re.compile(r"</?(?:" + "|".join(TAG_NAMES) + r")(?:\s[^>\n]{0,80})?\s*/?>", re.IGNORECASE)),
    (("#",), re.compile(r"^[ \t]*#{1,6}[ \t]+", re.MULTILINE)),
    (("- ", "-\t", "* ", "*\t", "+ ", "+\t"), re.compile(r"^[ \t]*[-*+][ \t]+", re.MULTILINE)),
    (("-", "=", "_", "*"), re.compile(r"^[ \t]*[-=_*]{3,}[ \t]*$", re.MULTILINE)),
    (("\\",), re.compile(r"\\[a-zA-Z]+\*?")),
)
_MARKS = "`*|~{}$\\"
_UNIFIED = {"'": APOSTROPHES, '"': DOUBLE_QUOTES, "-": HYPHENS, "": INVISIBLE}
_LINE_HYPHEN = re.compile(r"-\s*\n\s*")
_PUNCTUATION = re.compile(r"[^\w\s�]")
MOST_SPAN = 50

# A table's pieces: comments, tags, and the text between them.
_PIECE = re.compile(r"<!--.*?-->|</?[A-Za-z][^>]*>|[^<]+|<", re.DOTALL)
_TABLE = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.DOTALL | re.IGNORECASE)
_RULE = re.compile(r":?-{2,}:?")


def strip_markup(text: str | None) -> str:
    text = text or ""
    for signs, pattern in _MARKUP:
        if any(sign in text for sign in signs):
            text = pattern.sub(" ", text)
    for mark in _MARKS:
        text = text.replace(mark, " ")
    return text


def unify_characters(text: str) -> str:
    for one, alike in _UNIFIED.items():
        for c in alike:
            text = text.replace(c, one)
    return text


def _attribute(tag: str, name: str) -> int:
    found = re.search(rf"\b{name}\s*=\s*[\"']?[^\"'\s>]*?(\d+)", tag, re.IGNORECASE)
    return min(max(int(found[1]), 1), MOST_SPAN) if found else 1


def html_grid(table: str) -> list[list[str]] | None:
    """Raw cell texts by row and column; None where cells cannot be told from their surroundings.

    Cells that others span are empty; a cell ends where the next one, its row or the table ends.
    """
    cells: dict[tuple[int, int], list[str]] = {}
    taken: set[tuple[int, int]] = set()
    widths: list[int] = []
    row, depth, current = -1, 0, None
    for piece in _PIECE.findall(table):
        tag = re.match(r"<(/?)([A-Za-z][A-Za-z0-9]*)", piece)
        name = tag[2].lower() if tag else ""
        opening = bool(tag) and not tag[1]
        if name == "table":
            depth += 1 if opening else -1
            current = None
            if depth > 1:
                return None
        elif name == "tr":
            current = None
            if opening:
                row += 1
                widths.append(0)
        elif name in ("td", "th") and not opening:
            current = None
        elif name in ("td", "th"):
            if row < 0:
                row = 0
                widths.append(0)
            column = widths[row]
            while (row, column) in taken:
                column += 1
            wide, high = _attribute(piece, "colspan"), _attribute(piece, "rowspan")
            taken.update((row + r, column + c) for r in range(1, high) for c in range(wide))
            widths[row] = column + wide
            current = cells[row, column] = []
        elif current is not None:
            if opening or name not in ("tbody", "thead", "tfoot"):
                current.append(piece)
        elif not tag and piece.strip():
            return None
    if depth:
        return None
    return [["".join(cells.get((r, c), ())) for c in range(w)] for r, w in enumerate(widths)]


def header_repeats(header: list[str]) -> int | None:
    """How many times a header's labels repeat, or None."""
    labels = [re.sub(r"[\W_]+", " ", strip_markup(h)).strip().casefold() for h in header]
    labels = [x for x in labels if x]
    for period in range(1, len(labels) // 2 + 1):
        times, rest = divmod(len(labels), period)
        if not rest and labels == labels[:period] * times and re.search(r"[^\W\d_]", "".join(labels[:period])):
            return times
    return None


def by_column_group(grid: list[list[str]] | None) -> str | None:
    """A table with a repeated header, read one column group after the other."""
    if not grid or len(grid) < 2 or not (times := header_repeats(grid[0])):
        return None
    body = grid[1:]
    width = max(map(len, body))
    if not width or width % times:
        return None
    share = width // times
    cells = [*grid[0], *(c for g in range(times) for r in body for c in r[g * share : (g + 1) * share])]
    head = " ".join(c for c in cells[: len(grid[0])] if c.strip())
    return " " + " ".join([head, *(c for c in cells[len(grid[0]) :] if c.strip())]) + " "


def _pipe_rows(lines: list[str]) -> list[list[str]]:
    rows = ([c.strip() for c in line.strip().strip("|").split("|")] for line in lines)
    return [r for r in rows if not all(not c or _RULE.fullmatch(c) for c in r)]


def regroup_tables(text: str) -> str:
    """Repeated-header index tables by column group; everything else as it is."""
    if "|" not in text and "<table" not in text.lower():
        return text
    text = _TABLE.sub(lambda m: by_column_group(html_grid(m[0])) or m[0], text)
    out: list[str] = []
    block: list[str] = []
    for line in [*text.split("\n"), None]:
        if line is not None and line.lstrip().startswith("|"):
            block.append(line)
            continue
        regrouped = by_column_group(_pipe_rows(block)) if len(block) > 1 else None
        out += block if regrouped is None else [regrouped]
        block = []
        if line is not None:
            out.append(line)
    return "\n".join(out)


def diplomatic(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def reading(text: str | None) -> str:
    text = unify_characters(unicodedata.normalize("NFKC", strip_markup(regroup_tables(text or ""))))
    return " ".join(_LINE_HYPHEN.sub("", text).casefold().split())


def fold_diacritics(text: str) -> str:
    """Base letters only; ae and oe for their ligatures."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return bare.replace("æ", "ae").replace("œ", "oe").replace("Æ", "AE").replace("Œ", "OE")


def reading_folded(text: str | None) -> str:
    return fold_diacritics(reading(text))


#: Lanes by name: both sides of a comparison go through the same one.
LANES = {"diplomatic": diplomatic, "reading": reading, "reading_folded": reading_folded}


def tokens(text: str | None, lane: str = "reading") -> list[str]:
    return words(LANES[lane](text))


def words(normalized: str) -> list[str]:
    return _PUNCTUATION.sub(" ", normalized).split()


_BOTH = T.StructType([T.StructField("diplomatic", T.StringType()), T.StructField("reading", T.StringType())])


@batches.text_map(_BOTH)
def normalize(texts: list) -> list:
    """Both lanes of a text (null: empty)."""
    return [{"diplomatic": diplomatic(t), "reading": reading(t)} for t in texts]


def text_udf(function: Callable[[str], str]):
    """A function of one text as a column function."""
    return batches.text_map(T.StringType())(lambda texts: [function(t or "") for t in texts])


def lane_udf(lane: str):
    """One lane as a column function."""
    return text_udf(LANES[lane])
