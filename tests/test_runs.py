import json

import pytest
from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import rescore
from folioscope.sources import responses


def test_whole_run(spark, tmp_path, capsys):
    path = lambda n: str(tmp_path / n)
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    spark.createDataFrame([(i, f"v{i % 2}", "en", f"{text} {i}") for i in range(6)], "page_id long, volume string, language string, text string").write.parquet(path("gt"))
    for model, edit in (("rednote-hilab/dots.ocr", "alpha"), ("allenai/olmOCR-2-7B-1025-FP8", "alpah")):
        name = model.split("/")[1]
        rows = [(str(i), f"---\nlanguage: en\n---\n{text} {i}".replace("alpha", edit) if "olm" in name else f" {text} {i} ", None, "stop") for i in range(6)]
        spark.createDataFrame([*rows[1:], ("0", None, "busy", None)], "id string, raw string, error string, finish_reason string").coalesce(1).write.parquet(path(f"p-{name}"))
        spark.createDataFrame(rows[:1], "id string, raw string, error string, finish_reason string").coalesce(1).write.mode("append").parquet(path(f"p-{name}"))
        cli.main(["consolidate", path(f"p-{name}"), "--expect-rows", "6", "--out", path(f"c-{name}")])
        assert json.loads(capsys.readouterr().out)["superseded_by_retry"] == 1
        cli.main(["normalize", path(f"c-{name}"), "--model", model, "--out", path(f"n-{name}")])
        cli.main(["score", "--truth", path("gt"), "--outputs", path(f"n-{name}"), "--out", path(f"s-{name}")])
    cli.main(["board", path("s-dots.ocr"), path("s-olmOCR-2-7B-1025-FP8"), "--truth", path("gt"), "--out", path("board.json")])
    board = json.loads((tmp_path / "board.json").read_text())
    assert board["eligible_order"] == ["rednote-hilab/dots.ocr", "allenai/olmOCR-2-7B-1025-FP8"]
    assert board["scorecards"]["rednote-hilab/dots.ocr"]["cer_reading_micro"] == 0.0
    with pytest.raises(SystemExit):
        cli.main(["consolidate", path("p-dots.ocr"), "--expect-rows", "7", "--out", path("x")])


def test_answers(spark):
    body = json.dumps({"model": "m", "choices": [{"message": {"content": "t"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}})
    df = spark.createDataFrame([(body,), ('{"choices":[{"message":{"content":null}}]}',)], "b string")
    rows = df.select(*(c.alias(n) for n, c in responses.parse_answer(F.col("b")).items())).collect()
    assert tuple(rows[0]) == ("t", "stop", "m", 3, 4) and rows[1]["raw"] == ""
    text = spark.createDataFrame([("---\na: b\nc : d: e\n---\nx",), ("x",)], "t string").select(responses.front_matter(F.col("t"))).collect()
    assert json.loads(text[0][0]) == {"a": "b", "c": "d: e"} and text[1][0] is None
    blocks = spark.createDataFrame([('[{"error": true, "html": "x"}]',), ('[{"error": true, "html": ""}]',), (None,)], "b string").select(responses.page_status(F.col("b"))).collect()
    assert [r[0] for r in blocks] == ["length", "stop", "stop"]
    counts = responses.status_counts(spark.createDataFrame([("ok",), ("error: a",), ("error b",)], "status string")).collect()
    assert {r["status"]: r["n"] for r in counts} == {"ok": 1, "error": 2}
    image = spark.createDataFrame([(bytearray(b"abc"),)], "i binary")
    assert image.select(responses.data_url(responses.image_bytes(F.col("i"), "binary"), "x/y")).first()[0] == "data:x/y;base64,YWJj"
    with pytest.raises(TypeError):
        responses.image_bytes(F.col("i"), "string")
    assert responses.cache_key({"b": 1, "a": 2}) == responses.cache_key({"a": 2, "b": 1})


def test_revisions_hosts_and_plans(spark):
    full = "0" * 40
    assert responses.pin_revision("a/b", full) == full and responses.pin_revision("x.parquet", "main") is None
    assert responses.pin_revision("a/b", "main", lambda p, r: full) == full
    for args in (("a/b", "main"), ("a/b", "main", lambda p, r: "short")):
        with pytest.raises(ValueError):
            responses.pin_revision(*args)
    responses.refuse_routed("https://good.org/v1", ("router.org",))
    with pytest.raises(ValueError):
        responses.refuse_routed("https://x.router.org/v1", ("router.org",))
    truth = spark.createDataFrame([("1",), ("2",)], "page_key string")
    cache = spark.createDataFrame([("1", "t", None)], "page_id string, raw string, error string")
    made = responses.plan({"a": "u", "b": "u"}, truth, {"a": cache})
    assert [r["pending"] for r in made] == [1, 2, 3]
    responses.check_plan(made, 3, True, "/o/board", "/o/cards")
    for args in ((made, 2, True, "/o", "/c"), (made, None, False, "/o", "/c"), (made, None, True, "/c/board", "/c")):
        with pytest.raises(ValueError):
            responses.check_plan(*args)
    assert responses.cached_rows(cache, truth).count() == 1
    for bad in (cache.union(cache), cache.withColumn("page_id", F.lit("9")), cache.drop("raw"), cache.withColumn("raw", F.lit(1))):
        with pytest.raises(ValueError):
            responses.cached_rows(bad, truth)


def test_rescore(spark):
    schema = "model string, page_id string, cer_reading double, error boolean, truncated boolean"
    before = spark.createDataFrame([("m", "1", 0.5, False, False), ("m", "2", 0.5, False, False)], schema)
    after = spark.createDataFrame([("m", "1", 0.4, False, False), ("m", "2", 0.5, False, False)], schema)
    texts = lambda t: spark.createDataFrame([("m", "1", t, "x"), ("m", "2", "y", "y")], "model string, page_id string, text string, gt_text string")
    rescore.require_guarded(before, after, texts("<TABLE>"))
    with pytest.raises(ValueError):
        rescore.require_guarded(before, after, texts("plain"))
    with pytest.raises(ValueError):
        rescore.require_guarded(before, after.withColumn("error", F.lit(True)), texts("|"))
    assert rescore.summary(rescore.compare(before, after)).first().asDict() == {"rows": 1, "pages": 1, "better": 1, "worse": 0}
    pages = spark.createDataFrame([("m", "éa", "ea")], "model string, gt_text string, out_text string")
    assert tuple(rescore.accent_effect(pages).first()) == ("m", 0.5, 0.0)


def test_queries_match_their_sql(spark):
    """All queries with SQL, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from folioscope.plans import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")

    def plain(v):
        return None if v is None or v != v else tuple(v) if isinstance(v, (list, tuple)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, folder)
        found = con.sql(sql)
        order = sorted(df.columns)
        assert sorted(found.columns) == order, name
        want = sorted(repr([plain(r[found.columns.index(c)]) for c in order]) for r in found.fetchall())
        assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want, name
