import json
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import columns
from folioscope.operators import multiset, report, score, validate


def test_golden_multisets():
    words = lambda t: Counter(t.split())
    assert multiset.recall_support(words("echo echo echo other"), words("echo other")) == (2, 4)
    assert multiset.extra_support(words("echo"), words("echo echo echo")) == (2, 3)
    assert multiset.extra_support(words("a� a�"), words("ab ab ab")) == (1, 3)
    assert multiset.extra_support(words("�� a�"), words("ab cd")) == (0, 2)


@given(st.lists(st.text(alphabet="ab�", min_size=1, max_size=2), max_size=6), st.lists(st.text(alphabet="ab", min_size=1, max_size=2), max_size=6))
def test_wildcard_matching_is_maximal(patterns, words):
    def best(k, left):
        if k == len(patterns):
            return 0
        options = {w for w in left if len(w) == len(patterns[k]) and all(a in ("�", b) for a, b in zip(patterns[k], w, strict=True))}
        found = best(k + 1, left)
        for w in options:
            rest = list(left)
            rest.remove(w)
            found = max(found, 1 + best(k + 1, rest))
        return found

    assert multiset.wildcard_matches(Counter(patterns), Counter(words)) == best(0, words)


@given(st.text(alphabet="ab cd.", max_size=30), st.text(alphabet="ab cd.", max_size=30), st.text(alphabet="ab cd.", max_size=10))
def test_page_counts(ref, out, more):
    a, b = score.page_counts(ref, None, "", None, out), score.page_counts(ref, None, "", None, out + " " + more)
    assert 0 <= a["recall_matched"] <= a["recall_reference"] and 0 <= a["over_extraction_extra"] <= a["over_extraction_output"]
    assert b["recall_matched"] >= a["recall_matched"]  # more text never loses words
    assert a["cer_full_read_s"] == a["cer_body_read_s"]


@pytest.fixture(scope="module")
def truth(spark):
    rng = random.Random(1)
    rows = []
    for i in range(24):
        body = " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randint(3, 30)))
        regions = json.dumps([{"label": "header", "text": f"Head {i}"}, {"label": None, "text": body}, {"label": "empty", "text": ""}])
        rows.append((str(i), f"v{i % 3}", "en" if i % 2 else None, f"Head {i}\n{body}", body, f"Head {i}", regions))
    return spark.createDataFrame(rows, "page_key string, volume string, language string, text string, body_text string, furniture_text string, regions string")


@pytest.fixture(scope="module")
def outputs(truth):
    key = F.col("page_key").cast("int")
    good = truth.select(F.lit("good").alias("model"), "page_key", "text")
    bad = truth.select(F.lit("bad").alias("model"), "page_key", F.when(key == 1, "__ERR__Producer:x").when(key == 2, "__ERR__FinishReason:length").otherwise(F.replace("text", F.lit("alpha"), F.lit("alpah"))).alias("text"))
    part = truth.where(key > 1).select(F.lit("part").alias("model"), "page_key", "body_text").withColumnRenamed("body_text", "text")
    return good.unionByName(bad).unionByName(part)


@pytest.fixture(scope="module")
def cards(truth, outputs):
    return score.score_pages(score.join_outputs(outputs, truth)).cache()


def test_scorecards(cards):
    rows = {(r["model"], r["page_id"]): r for r in cards.collect()}
    r = rows["good", "3"]
    assert (r["recall"], r["over_extraction"], r["cer_full_read_s"], r["furniture_global_token_recall"]) == (1.0, 0.0, 0, 1.0)
    assert json.loads(r["region_global_token_recall"])["header"] == {"rate": 1.0, "matched": 2, "reference": 2}
    assert list(json.loads(r["region_global_token_recall"])) == ["?", "header"]
    assert rows["bad", "1"]["error"] and not rows["bad", "1"]["truncated"] and rows["bad", "1"]["recall"] == 0.0 and rows["bad", "1"]["over_extraction"] == 0.0
    assert rows["bad", "2"]["truncated"]
    for r in rows.values():
        n = r["cer_body_read_s"] + r["cer_body_read_d"] + r["cer_body_read_h"]
        assert r["cer_reading"] == round((r["cer_body_read_s"] + r["cer_body_read_d"] + r["cer_body_read_i"]) / n, 4)


def test_model_cards(cards, truth):
    rows = [r for r in cards.collect() if not r["error"]]
    got = {r["model"]: r for r in report.board_order(report.model_cards(cards, truth, full_text=True, replicates=50)).collect()}
    for model, card in got.items():
        mine = [r for r in rows if r["model"] == model]
        s, d, i, h = (sum(r[f"cer_body_read_{x}"] for r in mine) for x in "sdih")
        assert card["cer_reading_micro"] == round((s + d + i) / (s + d + h), 4)
        values = sorted(r["cer_reading"] for r in mine)
        k = len(values)
        assert card["cer_reading_median"] == round((values[(k - 1) // 2] + values[k // 2]) / 2, 4)
        assert set(card["by_volume"]) == {"v0", "v1", "v2"} and list(card["by_language"]) == ["en"]
        assert (card["cer_ci"]["lo"], card["cer_ci"]["hi"]) == bootstrap(mine, 50)
    assert (got["bad"]["errors"], got["bad"]["truncated"], got["bad"]["producer_errors"]) == (2, 1, 1)
    assert got["part"]["missing"] == 2 and not got["part"]["eligible"] and got["good"]["eligible"]
    assert [m for m in sorted(got) if got[m]["eligible"]] == ["good"]


def bootstrap(rows, n):
    """The definition: draw volumes in order of their first page, pool, round, take percentiles."""
    order = []
    for r in sorted(rows, key=lambda r: r["page_id"]):
        if r["volume"] not in order:
            order.append(r["volume"])
    rng, rates = random.Random(0), []
    for _ in range(n):
        drawn = [order[rng.randrange(len(order))] for _ in order]
        s, d, i, h = (sum(r[f"cer_body_read_{x}"] for v in drawn for r in rows if r["volume"] == v) for x in "sdih")
        rates.append(round((s + d + i) / (s + d + h), 4))
    rates.sort()

    def at(p):
        k = (n - 1) * p
        low = int(k)
        return round(rates[low] + (rates[min(low + 1, n - 1)] - rates[low]) * (k - low), 4)

    return at(0.025), at(0.975)


def test_model_cards_query_draws_all_replicates(spark, cards, truth, monkeypatch):
    from folioscope.plans import queries

    drawn, table = [], report._draw_table
    monkeypatch.setattr(queries, "_scored", lambda spark, sf_dir: cards)
    monkeypatch.setattr(queries.X, "truth", lambda spark, sf_dir: truth)
    monkeypatch.setattr(report, "_draw_table", lambda s, sizes, replicates, seed: drawn.append(replicates) or table(s, sizes, replicates, seed))
    rows = [r for r in cards.collect() if not r["error"]]
    for card in queries.model_cards(spark, "").collect():
        assert (card["lo"], card["hi"]) == bootstrap([r for r in rows if r["model"] == card["model"]], 1000)
    assert drawn == [1000]


def test_strata_regions_and_text(cards, truth, tmp_path):
    strata = {(r["model"], r["sample_stratum"]): r for r in report.stratum_cards(cards, ["content", "sparse_blank", "other"]).collect()}
    assert strata["good", "other"]["submitted"] == 0 and strata["good", "other"]["cer_reading_micro"] is None
    assert sum(r["n"] for (m, _), r in strata.items() if m == "bad") == 22
    regions = {(r["model"], r["label"]): r["rate"] for r in report.region_recall(cards, ["model"]).collect()}
    assert regions["part", "header"] < 0.1 and regions["good", "?"] == 1.0
    board = report.leaderboard(report.model_cards(cards, truth, replicates=10), {"x": 1})
    assert board["eligible_order"] == ["good"] and set(board["ineligible_order"]) == {"bad", "part"} and set(board["order"]) == {"good", "bad", "part"}
    text = report.format_board(board)
    assert text.index("eligible") < text.index("good") < text.index("not eligible")
    report.write_leaderboard(board, str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "b.json").read_text())["schema_version"] == C.REPORT_SCHEMA_VERSION
    assert "## coverage" in score.axis_catalogue() and all(a.name in score.axis_catalogue() for a in score.AXES)


def test_benchmark_provenance(truth):
    made = score.benchmark_provenance(truth, "d", None, None)
    validate.check_benchmark(made)
    assert made["expected_page_count"] == 24
    for change in ({"expected_page_count": 0}, {"expected_stratum_counts": {"content": 1}}, {"dataset_fingerprint": ""}, {"expected_page_count": True}):
        with pytest.raises(ValueError):
            validate.check_benchmark(made | change)
    with pytest.raises(ValueError):
        validate.check_benchmark({})
    with pytest.raises(ValueError):
        score.benchmark_provenance(truth.withColumn("sample_stratum", F.lit("content")), "d", None, None)
    with pytest.raises(ValueError):
        score.benchmark_provenance(truth.withColumn("sampler_seed", F.col("page_key")), "d", None, None)


def test_valid_rows_pass(cards):
    validate.require(cards.where("model <> 'part'"))
    assert validate.violations(cards).count() == 0


@pytest.mark.parametrize(
    ("column", "value", "check"),
    [
        ("model", "''", "model"), ("volume", "null", "volume"), ("sample_stratum", "'odd'", "stratum"), ("sample_stratum_threshold", "-1", "threshold"), ("error", "cast(null as boolean)", "error"),
        ("cer_body_dip_s", "-1", "counts cer_body_dip"), ("cer_body_read_i", "0.5", "counts cer_body_read"), ("recall_matched", "recall_reference + 1", "support recall"), ("recall", "0.123", "rate recall"),
        ("over_extraction", "0.9", "rate over_extraction"), ("cer_reading", "cer_reading + 0.1", "rate cer_reading"), ("cer_diplomatic", "cast(null as double)", "rate cer_diplomatic"), ("script_match", "1.5", "script_match"),
        ("region_global_token_recall", """'{"x": {"rate": 0.5, "matched": 3, "reference": 2}}'""", "regions"), ("norm_version", "'0'", "norm_version"), ("scorer_version", "null", "scorer_version"), ("score_provenance", "'{}'", "score_provenance"),
    ],
)
def test_row_checks(cards, column, value, check):
    broken = cards.where("model = 'good'").withColumn(column, F.expr(value))
    assert check in {r["check"] for r in validate.violations(broken).collect()}
    with pytest.raises(ValueError):
        validate.require(broken)


def test_table_checks(cards):
    good = cards.where("model = 'good'")
    one = good.where("page_id = '3'")
    other = good.withColumn("model", F.lit("x"))
    cases = {
        "duplicate": good.union(one),
        "mixed norm_version": good.union(other.withColumn("norm_version", F.lit("y"))),
        "stratum conflict": good.union(other.withColumn("sample_stratum", F.when(F.col("page_id") == "3", "sparse_blank").otherwise("content"))),
        "threshold": good.union(other.withColumn("sample_stratum_threshold", F.lit(5))),
        "page sets": good.union(other.where("page_id <> '3'")),
        "mixed run": good.withColumn("run_provenance", F.when(F.col("page_id") == "3", "a").otherwise("b")),
    }
    for check, rows in cases.items():
        assert check in {r["check"] for r in validate.table_violations(rows).collect()}, check
    validate.require(cases["page sets"], require_complete=False)
    with pytest.raises(ValueError):
        validate.require(good.limit(0))
    with pytest.raises(ValueError):
        validate.require(good.drop("volume"))


def test_join_checks(outputs, truth):
    validate.check_join(outputs, truth)
    for out, gt in ((outputs.union(outputs.limit(1)), truth), (outputs, truth.union(truth.limit(1))), (outputs, truth.where("page_key <> '3'")), (outputs.withColumn("text", F.lit(None).cast("string")), truth), (outputs.withColumn("page_key", F.lit(None).cast("string")), truth)):
        with pytest.raises(ValueError):
            validate.check_join(out, gt)


def test_round_trip_of_scorecards(cards, spark, tmp_path):
    from folioscope.sources import sinks

    again = sinks.write_verified(sinks.flat_scorecards(cards), str(tmp_path / "s"))
    assert sorted(map(str, again.collect())) == sorted(map(str, cards.collect()))
    validate.require(again.where("model <> 'part'"))
    assert columns.stable_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
