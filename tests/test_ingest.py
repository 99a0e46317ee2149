import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import consolidate, crosscheck, language, layout, pagetests, postproc, sampling
from folioscope.sources import parts, sinks
from folioscope.streaming import ingest

PARTS = "page_id string, raw string, error string, finish_reason string, row_ord long"


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([("1", "a", None, "stop", 0), ("2", None, "boom", None, 1), ("2", "b", None, "stop", 2), ("3", "c", None, "length", 3), ("4", None, None, None, 4), ("4", None, "x", None, 5), ("5", "", None, "stop", 6)], PARTS)


def test_consolidate(rows):
    got = {r["page_id"]: (r["raw"], r["raw_verbatim"], r["row_ord"]) for r in consolidate.consolidate(rows).collect()}
    assert got == {"1": ("a", "a", 0), "2": ("b", "b", 2), "3": ("__ERR__FinishReason:length", "c", 3), "4": ("__ERR__Producer:empty response", None, 4), "5": ("", "", 6)}
    counts = consolidate.counts(rows, consolidate.consolidate(rows)).first().asDict()
    assert counts == {"rows": 5, "ok": 3, "producer_errors": 1, "truncated": 1, "truncation_rate": 0.2, "superseded_by_retry": 2, "finish_reasons": {"length": 1, "stop": 3}}
    with pytest.raises(ValueError):
        consolidate.consolidate(rows.union(rows.where("page_id = '1'")))
    with pytest.raises(ValueError):
        consolidate.with_key(rows.withColumn("id", F.lit(1)))
    wanted = rows.select("page_id").distinct()
    assert consolidate.pending(wanted, rows).count() == 0
    assert [r[0] for r in consolidate.pending(wanted, rows, retry_errors=True).collect()] == ["4"]


def test_quotas():
    assert sampling.quotas({"content": 99, "sparse_blank": 1}, 2, True) == {"content": 1, "sparse_blank": 1}
    assert sampling.quotas({"content": 99, "sparse_blank": 1}, 2) == {"content": 2, "sparse_blank": 0}
    assert sampling.quotas({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    made = sampling.volume_quotas({"large": 12, "small": 2, "tiny": 1}, 9)
    assert sum(made.values()) == 9 and made["tiny"] == 1 and made["small"] == 2
    with pytest.raises(ValueError):
        sampling.quotas({"a": 1}, 2)


def test_sample(spark):
    pages = spark.createDataFrame([(f"{v}{s}{i}", v, s) for v, n in (("large", 12), ("small", 2), ("tiny", 1)) for s in ("content", "sparse_blank") for i in range(n)], "page_key string, volume string, sample_stratum string")
    got = sampling.volume_spread_sample(pages, 10)
    assert got.count() == 10 and {r["volume"] for r in got.collect()} == {"large", "small", "tiny"}
    assert sorted(got.collect()) == sorted(sampling.volume_spread_sample(pages.repartition(7), 10).collect())
    assert sampling.volume_spread_sample(pages, 99).count() == 30
    with pytest.raises(ValueError):
        sampling.shard(pages, 3, 3)


def test_language(spark):
    long = "x" * 120
    rows = [("1", "v", long, "__label__deu_Latn", 0.9, 0), ("2", "v", long, "__label__eng_Latn", 0.9, 1), ("3", "v", long, "__label__eng_Latn", 0.2, 2), ("4", "v", "short", "__label__eng_Latn", 0.9, 3), ("5", "w", long, "nds_Latn", 0.9, 4)]
    pages = spark.createDataFrame(rows, "page_id string, volume string, text string, label string, conf double, row_ord long")
    assert {r["volume"]: r["language"] for r in language.majority(pages).collect()} == {"v": "de", "w": "und"}
    cards = spark.createDataFrame([("1", "xx", 1.0), ("9", "yy", 2.0)], "page_id string, language string, cer double")
    after = language.restamp(cards, language.label_pages(pages))
    assert after.columns == cards.columns and sorted(map(tuple, after.collect())) == [("1", "de", 1.0), ("9", "yy", 2.0)]
    assert language.restamped(cards, after) == 1


CASES = [
    (postproc.unwrap_fence, "```markdown\nx\n```", "x"), (postproc.unwrap_fence, "```a``` b ```c```", "```a``` b ```c```"), (postproc.unwrap_fence, "```x = 1\ny```", "x = 1\ny"),
    (postproc.nuextract3_strip_thinking, "<think>a</think> b ", "b"), (postproc.nuextract3_strip_thinking, " a</think> b", "a</think> b"), (postproc.qianfan_strip_thinking, "a</think> b", "b"),
    (postproc.drop_front_matter, "---\na: b\n---\nbody\n", "body\n"), (postproc.drop_front_matter, "---\na: b\n---", ""), (postproc.drop_front_matter, "body", "body"),
    (postproc.drop_bbox_blocks, 'a\n\n<img src="images/bbox_1.png">\n\nb', "a\n\nb"), (postproc.falcon_strip_unused_tokens, "a>>UNUSED_3<<b", "ab"), (postproc.oxr_drop_image_links, "a ![x](y) b", "a  b"),
    (postproc.strip_underscore_emphasis, "_a b_ c_d_e", "a b c_d_e"), (postproc.strip_edge_specials, "<｜begin▁of▁sentence｜> a<｜end▁of▁sentence｜>", "a"),
    (postproc.remove_det, "<|det|>title [1, 2, 3, 4]<|/det|>T\nmore\n<|det|>image [1, 2]<|/det|>\n<|det|>text<|/det|>B", "T\nmore\n\nB"),
    (postproc.deepseek_strip_grounding, "<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nHello", "Hello"), (postproc.unlimited_ocr_to_markdown, "text [264, 188, 638, 205]<|/det|>\nHello", "Hello"),
    (postproc.clean_repeated_substrings, "x" * 1990 + "ab" * 50, "x" * 1990 + "ab"), (postproc.clean_repeated_substrings, "ab" * 50, "ab" * 50),
    (postproc.chandra_html_to_markdown, '<div data-label="Page-Header">h</div><div data-label="Text">a &amp; b*</div><div data-label="Section-Header"><h2>T</h2></div><div data-label="Figure"><img alt="x"></div>', "a & b\\*\n\n## T"),
    (postproc.html_to_markdown, "<ul><li>a<li>b <i>c</i></ul><p>x <math>y_1</math> z</p><table><tr><td>1</td></tr></table>", "- a\n- b *c*\n\nx  $y_1$  z\n\n<table><tr><td>1</td></tr></table>"),
    (postproc.surya_blocks_to_markdown, json.dumps([{"reading_order": 1, "skipped": False, "html": "<p>b</p>", "raw_label": "Text", "label": "text"}, {"reading_order": 0, "skipped": False, "html": "204", "raw_label": "Page-Header", "label": "x"}, {"reading_order": 2, "skipped": True, "html": "c", "raw_label": "", "label": ""}]), "204\n\nb"),
    (layout.convert, "<PAGE><BLOCK>title<LEVEL1>[1, 2, 3, 4] A\n<BLOCK>title<LEVEL1>[1, 2, 3, 5] B\n<BLOCK>text[1, 2, 3, 4]one <MERGE><BLOCK>text[1,2,3,4]two<PAGE><BLOCK>append_text[1,2,3,4]x\n<BLOCK>image[1,2,3,2000]", "# A B\n\nonetwo\n\nx\n\n![](page2_1_2_3_1000.jpg)"),
    (layout.convert, "<PAGE><BLOCK>table[1,2,3,4]<table><tr><th>h</th></tr><tr><td>1</td></tr></table><PAGE><BLOCK>append_table[1,2,3,4]<table><tr><th>H</th></tr><tr><td>2</td></tr></table>", "<table><tr><th>h</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"),
    (layout.convert, "hello plain page", "hello plain page"), (layout.convert, None, ""), (layout.convert, "```markdown\n<PAGE>\n<PAGE>two\n```", "two"),
    (layout.convert, "<PAGE>\n<PAGE><BLOCK>seal[7,8,9,10]<FORK>", "![](page2_7_8_9_10.jpg)"), (layout.convert, "lead <LEVEL2> text<BLOCK>text[7,8,9,10]<FORK>body<PAGE>  <PAGE>third", "lead  text\n\nbody\n\nthird"),
    (layout.convert, "text[7,8,9,10]first\n<FORK>\ntitle<LEVEL3>[7,8,9,10]  A  \n b\nnote[7,8,9,10] stays", "first\n\n### A b note[7,8,9,10] stays"),
    (layout.convert, "<BLOCK>cross_table[7,8,9,10]<table><tr><td>1</td></tr></table><PAGE><BLOCK>table[7,8,9,10]<table><tr><td>x</td></tr></table><PAGE><BLOCK>append_table[7,8,9,10]<table><tr><td>2</td></tr></table>", "<table><tr><td>1</td></tr></table>\n\n<table><tr><td>x</td></tr><tr><td>2</td></tr></table>"),
    (layout.convert, "<BLOCK>cross_text[7,8,9,10]a <PAGE><BLOCK>figure[7,8,9,10][Figure]<PAGE><BLOCK>append_text[7,8,9,10]b<BLOCK>append_text[7,8,9,10]c", "abc\n\n![](page2_7_8_9_10.jpg)"),
    (layout.convert, '<BLOCK>table[7,8,9,10]<table><tr><td colspan="2x" rowspan="3">\\coloneqq</td></tr></table>\n[7, 8, 9, 10]\n<BLOCK>text[7,8,9,10]###', '<table><tr><td colspan="2" rowspan="3">:=</td></tr></table>'),
    (postproc.unlimited_ocr2_to_markdown, "<BLOCK>image[7,8,9,10]<FORK><BLOCK>text[7,8,9,10]<FORK>caption", "caption"),
    (layout.convert, "<PAGE><BLOCK>title<LEVEL1>[1,2,3,4]A\n<BLOCK>text[1,2,3,4]t\n<BLOCK>title<LEVEL1>[1,2,3,4]B", "# A\n\nt\n\n## B"),
]


@pytest.mark.parametrize(("step", "text", "want"), CASES)
def test_transforms(step, text, want):
    assert step(text) == want


@pytest.mark.parametrize(("step", "text"), [(postproc.qianfan_strip_thinking, "<think>a"), (postproc.deepseek_strip_grounding, "a <|x|>"), (postproc.surya_blocks_to_markdown, "{"), (postproc.nemotron_parse_to_markdown, "x"), (postproc.unlimited_ocr2_to_markdown, "<BLOCK>text[7,8,9,10]hello <BLOCK x> world"), (postproc.unlimited_ocr2_to_markdown, "a < |x y| > b")])
def test_failing_transforms(step, text):
    got, done, error = postproc.apply(text, (postproc.identity, step, postproc.identity))
    assert got is None and done == ["identity"] and error.startswith(step.__name__)


def test_normalize_frame(spark):
    data = [(m, f"  text {i} ![x](y) >>UNUSED_1<< _em_ ") for i, m in enumerate(postproc.REGISTRY)] + [("SoMarkAI/OXR-1.0", "__ERR__x"), ("baidu/Qianfan-OCR", "<think>no end")]
    got = postproc.normalize_frame(spark.createDataFrame(data, "model string, raw string"))
    for r in got.collect():
        if r["raw"].startswith("__ERR__"):
            assert r["markdown"] == r["raw"] and r["transforms_applied"] == []
            continue
        text, done, error = postproc.apply(r["raw"], postproc.resolve(r["model"]))
        assert (r["markdown"], r["transforms_applied"], r["normalize_error"]) == (text if error is None else f"__ERR__{error}", done, error)
    assert got.count() == len(data)
    frame = lambda rows, schema="model string, raw string": spark.createDataFrame(rows, schema)
    for bad in (frame([]), frame([("x/unknown", "a")]), frame([(" ", "a")]), frame([("SoMarkAI/OXR-1.0", None)]), frame([("SoMarkAI/OXR-1.0", 1)], "model string, raw int"), frame([("LiquidAI/LFM2.5-VL-1.6B-Extract", "a")])):
        with pytest.raises(ValueError):
            postproc.normalize_frame(bad)
    assert postproc.normalize_frame(frame([("x/unknown", "a")]), identity_for_unregistered=True).first()["transforms_applied"] == ["identity"]
    with pytest.raises(ValueError):
        postproc.normalize_frame(frame([("SoMarkAI/OXR-1.0", "a")]), out="raw")


def test_page_tests(spark):
    words = "The quick brown foxes jump over lazy dogs while several careful readers count every single printed word here and nobody else notices anything strange about this long sentence".split()
    a, b = " ".join(words), " ".join(reversed(words))
    regions = [{"label": "text", "text": a, "box": [0, 0, 10, 10]}, {"label": "text", "text": b, "box": [0, 20, 10, 30]}]
    tests = pagetests.page_tests(a + "\n" + b, regions)
    kinds = [t["basis"] for t in tests]
    assert kinds.count("presence") == 3 and kinds.count("intra_region") == 2 and kinds.count("vertical_blocks") == 1
    assert all(t["before_pos"] < t["after_pos"] for t in tests if t["test_type"] == "order")
    assert pagetests.page_tests(a + " " + a, regions[:1]) == []  # nothing is unique
    df = spark.createDataFrame([("1", "v", a + "\n" + b, json.dumps(regions)), ("2", None, None, None)], "page_key string, volume string, text string, regions string")
    got = pagetests.with_ids(pagetests.generate(df))
    assert got.count() == 6 and got.select("test_id").distinct().count() == 6
    assert pagetests.distinct_starts([0, 1, 30, 31, 100], 40) == [0, 30, 100] and pagetests.spread([*range(10)], 3) == [0, 3, 6]
    assert not pagetests.is_single_column([[0, 0, 5, 10], [6, 1, 9, 11]]) and pagetests.max_diffs(28, 0.04) == 1


def test_crosscheck(spark):
    left = spark.createDataFrame([("d/7.xml", "abcd"), ("8.xml", "abcd"), ("9.xml", "x")], "xml_path string, text string")
    right = spark.createDataFrame([("7", "abcd"), ("8", "abxx")], "gt_page_id string, text string")
    joined = crosscheck.match(left, right)
    rows = joined.select("gt_page_id", crosscheck.agreement(F.col("text"), F.col("other_text")).alias("agreement"), crosscheck.agreement(F.col("text"), F.coalesce("other_text", F.lit("")), False).alias("slow"))
    assert {r["gt_page_id"]: (r["agreement"], r["slow"]) for r in rows.collect()} == {"7": (1.0, 1.0), "8": (0.5, 0.5), "9": (None, 0.0)}
    stats = crosscheck.summary(rows).first().asDict()
    assert stats == {"n": 2, "median": 0.75, "mean": 0.75, "at_least_95": 1, "at_least_85": 1, "p10": 0.5}
    assert [r[0] for r in crosscheck.lowest(rows, key="gt_page_id").collect()] == ["8"]
    cards = spark.createDataFrame([("h1", "7"), ("h2", "7")], "source_sha256 string, page_id string")
    source = spark.createDataFrame([("h1", "7", "t")], "source_sha256 string, page_id string, text string")
    assert {r["source_sha256"]: r["source_text"] for r in crosscheck.by_content(cards, source).collect()} == {"h1": "t", "h2": None}


def test_sources(spark, tmp_path):
    for k in range(3):
        pd.DataFrame({"id": [f"{k}a", f"{k}b"], "raw": ["x", "y"]}).to_parquet(tmp_path / f"part-r00-{k:05d}.parquet")
    df, n = parts.read_parts(spark, str(tmp_path))
    assert n == 3 and [r["id"] for r in df.orderBy("row_ord").collect()] == ["0a", "0b", "1a", "1b", "2a", "2b"]
    one, n = parts.read_parts(spark, str(tmp_path / "part-r00-00001.parquet"))
    assert n == 1 and one.count() == 2
    with pytest.raises(ValueError):
        parts.union_globs(spark, [str(tmp_path)])
    images = tmp_path / "img" / "deep"
    images.mkdir(parents=True)
    (images / "a.png").write_bytes(b"1")
    (images / "b.JPG").write_bytes(b"2")
    (images / "c.txt").write_bytes(b"3")
    got = {r["rel"]: r["md"] for r in parts.image_files(spark, str(tmp_path / "img")).collect()}
    assert got == {"deep/a.png": "deep/a.md", "deep/b.JPG": "deep/b.md"}
    (images / "a.jpg").write_bytes(b"4")
    with pytest.raises(ValueError):
        parts.image_files(spark, str(tmp_path / "img"))
    assert parts.file_hashes(spark, str(images / "c.txt")).first()["sha256"].startswith("4e07408562bedb8b60ce05c1decfe3ad")
    doc = json.dumps({"texts": [{"label": "h", "content_layer": "furniture", "text": "H"}, {"label": "t", "content_layer": "body", "text": "B"}, {"label": "t", "content_layer": "body", "text": ""}, {"label": "t", "content_layer": "body", "text": "C"}]})
    row = spark.createDataFrame([(doc,), ("{}",)], "d string").select(parts.layer_text(F.col("d"), "body"), parts.layer_text(F.col("d"), "furniture"), parts.regions(F.col("d"))).collect()
    assert tuple(row[0])[:2] == ("B\nC", "H") and len(json.loads(row[0][2])) == 3 and tuple(row[1]) == ("", "", "[]")


@pytest.mark.parametrize("text", ['{"seed": 1, "seed": 2}', '{"temperature": NaN}', '{"max_tokens": 0}', '{"temperature": 9}', '{"x": 1}', '{"seed": true}', "[]", '{"extra_body": {"seed": 1}}', '{"max_tokens": 1.5}'])
def test_bad_settings(text):
    with pytest.raises(ValueError):
        parts.request_settings(text)


def test_settings_and_literals(tmp_path):
    assert parts.request_settings('{"top_p": 0.5}') == {"max_tokens": 16384, "temperature": 0, "top_p": 0.5} and parts.request_settings(None) == parts.DEFAULTS
    (tmp_path / "m.py").write_text("import nothing\nPROMPT = 'a' 'b'\n")
    assert parts.literal_from_module(str(tmp_path / "m.py"), "PROMPT") == "ab"
    (tmp_path / "p.json").write_text("[]")
    with pytest.raises(ValueError):
        parts.read_provenance(str(tmp_path / "p.json"))


def test_sinks(spark, tmp_path):
    names = [sinks.part_name(0, 0), sinks.part_name(0, 4), sinks.part_name(1, 9), "part-x.parquet"]
    assert (sinks.next_part_index(names, 0), sinks.next_part_index(names, 1), sinks.next_part_index(names, 2)) == (5, 10, 0)
    df = spark.createDataFrame([("a/b.md", "t", "1"), ("c.md", None, "2")], "md string, text string, page_id string")
    assert sinks.write_texts(df, str(tmp_path)) == 2 and (tmp_path / "a/b.md").read_text() == "t"
    assert "archived-" in sinks.archive(str(tmp_path), ["c.md"]) and not (tmp_path / "c.md").exists()
    page = "<p><!-- board:begin -->old<!-- board:end --></p>"
    assert "old" not in sinks.bake(page, "board", [1, "</script>"]) and sinks.bake(page, "board", 1).count("begin") == 1
    with pytest.raises(ValueError):
        sinks.bake("", "board", 1)
    card = {"cer_reading_micro": 0.1, "cer_ci": None, "recall_micro": 1, "over_extraction_micro": 0, "truncation_rate": 0, "eligible": True, "n": 1}
    board = {"order": ["a", "b"], "scorecards": {"a": card, "b": card | {"n": 0}}}
    assert sinks.board_rows(board, {"a": {"params": 1}, "b": {}})[1] == ["b"]
    with pytest.raises(KeyError):
        sinks.board_rows(board, {})
    script, known = sinks.launch_script([{"model": "m", "command": "run"}, {"model": "n", "command": "run"}], {"m": "1"}, lambda m: m.upper())
    assert "--revision 1" in script and known == {"m": "1", "n": "N"}
    made = sinks.run_provenance(df, {"run_id": 1}, text="text")
    assert made["outputs"]["rows"] == 2 and made == sinks.run_provenance(df.repartition(5), {"run_id": 1}, text="text")
    info = spark.createDataFrame([(None,), ('[{"a":"1"}]',)], "i string").select(sinks.append_info("i", {"m": 2})).collect()
    assert [len(json.loads(r[0])) for r in info] == [1, 2]
    doubtful = spark.createDataFrame([("1", "w", "de", 0.2, "<t>"), ("2", "trudy1", "en", 0.3, "u"), ("3", "v", "en", 0.9, "z")], "page_id string, volume string, label string, conf double, text string")
    text = sinks.review_page(doubtful, 0.5, "trudy")
    assert text.index("trudy1") < text.index("&lt;t&gt;") and 'data-id="3"' not in text


def test_streaming(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    part = lambda rows, name: spark.createDataFrame(rows, ingest.PART).coalesce(1).write.mode("append").parquet(source)
    part([("1", "a", None, "stop", "m"), ("2", None, "busy", None, "m")], 0)
    ingest.append_parts(spark, source, target, mark)
    part([("2", "b", None, "stop", "m"), ("3", "c", None, "length", "m")], 1)
    ingest.append_parts(spark, source, target, mark)
    ingest.append_parts(spark, source, target, mark)
    assert spark.read.parquet(target).count() == 4
    assert {r["page_id"]: r["raw"] for r in ingest.current(spark, target).collect()} == {"1": "a", "2": "b", "3": "c"}


def test_service(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return prompt, "stop"

    assert ingest.answer(flaky, "p") == ("p", None) and len(calls) == 3
    assert ingest.answer(lambda p: (None, "stop"), "p")[0] == "__ERR__EmptyContent"
    assert ingest.answer(lambda p: ("x", "length"), "p") == ("__ERR__FinishReason:length", None)
    assert ingest.answer(lambda p: ("", "stop"), "p") == ("", None)
    assert [*ingest.ordered_window(lambda x: x * 2, iter(range(20)), 3)] == [x * 2 for x in range(20)]
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "page_id string, prompt string")
    got = ingest.map_service(df, lambda p: (p.upper(), "stop"))
    assert {r["page_id"]: r["raw"] for r in got.collect()} == {"1": "A", "2": "B"}
