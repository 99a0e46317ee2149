import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import align, columns, lanes, script

TEXT = st.text(alphabet="abcde ABCDE ſﬁﬂßäöéçñ абвгд�", max_size=40)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(TEXT)
def test_lanes_are_idempotent(text):
    for lane in lanes.LANES.values():
        assert lane(lane(text)) == lane(text)


@given(TEXT.map(lambda t: t.replace("�", "")), TEXT)
def test_edit_counts(ref, out):
    s, d, i, h = align.edit_counts(ref, out)
    assert s + d + i == distance(ref, out)
    assert not ref or (s + d + h == len(ref) and s + h + i == len(out))


@given(TEXT, TEXT)
def test_illegible_characters_never_add_errors(ref, out):
    s, d, i, _ = align.edit_counts(ref, out)
    assert s + d + i <= max(distance(ref, out), 0) and (ref or (s, d, i) == (0, 0, len(out)))


@settings(max_examples=60)
@given(TEXT.map(lambda t: t.replace("�", "")), TEXT)
def test_halving_keeps_the_distance(ref, out):
    old, align.MOST_CELLS = align.MOST_CELLS, 12
    try:
        s, d, i, _ = align.edit_counts(ref, out)
    finally:
        align.MOST_CELLS = old
    assert s + d + i == distance(ref, out)


def test_golden_counts():
    assert align.edit_counts("ab��ef", "abXYef") == (0, 0, 0, 4)
    assert align.edit_counts("", "abc") == (0, 0, 3, 0)
    assert align.distance(lanes.diplomatic("the ſong"), lanes.diplomatic("the song")) > 0
    assert lanes.reading("the ſong") == lanes.reading("the song")


@pytest.mark.parametrize("seed", range(30))
def test_find_within(seed):
    rng = random.Random(seed)
    needle, text = ("".join(rng.choice("ab") for _ in range(rng.randint(lo, hi))) for lo, hi in ((2, 6), (0, 14)))
    want = [(j, n) for j in range(1, len(text) + 1) if (n := min(distance(needle, text[i:j]) for i in range(j + 1))) <= 2]
    assert align.find_within(needle, text, 2) == want


HEADER = ["", "Plate.", "Species."] * 2
ROWS = [["A", "1", "2", "B", "3", "4"], ["C", "5", "6", "D", "7", "8"]]


def html(rows, cell="td"):
    return "<table>" + "".join("<tr>" + "".join(f"<{cell}>{c}</{cell}>" for c in r) + "</tr>" for r in rows) + "</table>"


def pipe(rows):
    return "\n".join("|" + "|".join(r) + "|" for r in [rows[0], ["--"] * len(rows[0]), *rows[1:]])


@pytest.mark.parametrize("text", [html([HEADER, *ROWS]), html([HEADER, *ROWS], "th"), pipe([HEADER, *ROWS]), html([["", "Plate.", "Species.", "", "plate", "SPECIES"], *ROWS])])
def test_repeated_headers_are_read_by_group(text):
    assert re.sub(r"[.]", "", lanes.reading(text)) == "plate species plate species a 1 2 c 5 6 b 3 4 d 7 8"


@pytest.mark.parametrize("text", [html([["a", "b", "c"], *ROWS]), html([HEADER, ["A", "1", "2"]]), html([HEADER]), html([HEADER, *ROWS]).replace("<table>", "<table><caption>x</caption>"), html([HEADER, [html([["x"]]), *ROWS[0][1:]]]), "a | b", "no table"])
def test_other_tables_stay(text):
    assert lanes.regroup_tables(text) == text


def test_spans_and_implied_closes():
    assert lanes.html_grid("<table><tr><td colspan=2>a<td rowspan='2'>b<tr><td>c<td>d<td>e</table>") == [["a", "", "b"], ["c", "d", "", "e"]]
    grid = lanes.html_grid("<table><tr><td colspan=2>a<td>b</tr><tr><td>c<td>d<td>e</tr></table>")
    assert grid == [["a", "", "b"], ["c", "d", "e"]]


def test_markup():
    assert lanes.strip_markup("<b>x</b> <Hand>").split() == ["x", "<Hand>"]
    assert lanes.reading("# T\n- a\n---\n<|ref|>b<|/ref|>[[1, 2]] \\gamma $c$ re-\n cord “q”") == 't a b c record "q"'
    assert lanes.tokens("a� b,c.") == ["a�", "b", "c"]
    assert lanes.reading_folded("Æon é œuvre") == "aeon e oeuvre"


def test_scripts():
    assert script.script_match("абв ef", "абвгд") == 0.6
    assert script.dominant_script("漢 a") == "latin" and script.dominant_script("12") is None
    assert script.script_of("가") == "han" and script.script_of("漢") == "other"


def test_round4_equals_python(spark):
    rng = random.Random(1)
    values = [1 / 32, 2469 / 20000, 0.0, 1.0, 2.0, 0.00005, 0.12345, 0.99995, *(rng.randrange(1, 10**6) / rng.randrange(1, 10**6) for _ in range(3000)), *((2 * k + 1) / 20000 for k in range(2000)), *(k / 32 for k in range(64))]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(columns.round4(F.col("x"))).collect()]
    assert got == [round(v, 4) for v in values]


def test_keys_and_predicates(spark):
    ids = [("7", "7"), ("7.0", "7"), (" 7.00 ", "7"), ("-0.0", "0"), ("07.0", "07.0"), ("a", "a"), ("", None), ("  ", None), (None, None), ("nan", None), ("1.50", "1.50"), ("true", "true")]
    got = spark.createDataFrame(ids, "a string, b string").select("b", columns.page_key(F.col("a"))).collect()
    assert all(a == b for a, b in got)
    texts = [("__ERR__x", True, False), ("__ERR__FinishReason:length", True, True), (" [OCR Error: x] ", True, False), ("an [error] here", False, False), ("", False, False), (None, False, False)]
    rows = spark.createDataFrame(texts, "t string, e boolean, c boolean").select("e", "c", columns.is_error(F.col("t")).alias("e2"), columns.is_truncated(F.col("t")).alias("c2")).collect()
    assert all(r["e"] == r["e2"] and r["c"] == r["c2"] for r in rows)
    s = spark.createDataFrame([("x" * 79,), ("x" * 80,), (None,)], "t string").select(columns.stratum(F.col("t"))).collect()
    assert [r[0] for r in s] == ["sparse_blank", "content", "sparse_blank"]
    with pytest.raises(ValueError):
        columns.stratum(F.col("t"), True)
    codes = spark.createDataFrame([("__label__deu_Latn",), ("nds_Latn",), ("eng",)], "l string").select(columns.short_code(F.col("l"))).collect()
    assert [r[0] for r in codes] == ["de", "und", "en"]
    slugs = spark.createDataFrame([("a/b c",), ("--",), ("x" * 99,)], "s string").select(columns.slug(F.col("s"))).collect()
    assert [r[0] for r in slugs] == ["a-b-c", "model", "x" * 80]


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("é",)], "page_key string")
    want = hashlib.sha256('["a","b","é"]'.encode()).hexdigest()
    assert columns.page_set_fingerprint(df) == want == df.agg(columns.fingerprint_column(F.col("page_key"))).first()[0]
    with pytest.raises(ValueError):
        columns.page_set_fingerprint(df.union(df))


def test_images(spark):
    df = spark.createDataFrame([(1000, 700), (3000, 2000), (100, 90)], "h int, w int")
    for h, w, got, n, m in df.select("h", "w", columns.smart_resize(F.col("h"), F.col("w")), columns.image_tokens(F.col("h"), F.col("w")), columns.image_tokens(F.col("h"), F.col("w"), "patch_32")).collect():
        assert got["height"] % 28 == got["width"] % 28 == 0 and 101_920 <= got["height"] * got["width"] <= 1_003_520
        assert n == (w // 28 + 1) * (h // 28) and m == -(-w // 32) * -(-h // 32)
