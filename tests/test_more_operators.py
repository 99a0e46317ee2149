"""Validation against a benchmark, resumable runs, ranked parts, geometry, page tests and their report."""

import glob
import json
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import align, columns, geometry
from folioscope.operators import language, multiset, pagetests, report, sampling, score, validate
from folioscope.sources import responses, sinks
from folioscope.streaming import ingest

SAMPLER = {"sampler_version": "1", "sampler_source_repo": "a/b", "sampler_source_revision": "c", "sampler_seed": 7, "sampler_requested_n": 5}


@pytest.fixture(scope="module")
def scored(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    truth = spark.createDataFrame([(str(i), f"v{i % 3}", "en", f"{text} {i}") for i in range(12)], "page_key string, volume string, language string, text string")
    out = truth.select("page_key", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "text")
    benchmark = score.benchmark_provenance(truth, "d", None, None)
    rows = score.score_pages(score.join_outputs(out, truth)).withColumn("benchmark_provenance", F.lit(columns.stable_json(benchmark)))
    return truth, benchmark, rows.cache()


def test_rows_against_their_benchmark(scored):
    truth, benchmark, rows = scored
    expected = truth.select(F.col("page_key").alias("page_id"))
    validate.require(rows)
    validate.require(rows, expected=expected)
    # All models lack the same page: only the benchmark can tell.
    short = rows.where("page_id <> '3'")
    for given in (None, expected):
        with pytest.raises(ValueError, match="page"):
            validate.require(short, expected=given)
        validate.require(short, require_complete=False, expected=given)
    with pytest.raises(ValueError, match="page"):
        validate.require(rows.withColumn("page_id", F.when(F.col("page_id") == "3", "33").otherwise(F.col("page_id"))))
    with pytest.raises(ValueError, match="stratum"):
        validate.require(rows.withColumn("sample_stratum", F.when(F.col("page_id") == "3", C.STRATA[1]).otherwise(F.col("sample_stratum"))), require_complete=False)
    with pytest.raises(ValueError, match="postproc_version"):
        validate.require(rows.withColumn("postproc_version", F.when(F.col("model") == "a", "9").otherwise("0")))
    for bad in (expected.limit(11), expected.unionByName(expected.limit(1)), expected.withColumn("page_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            validate.require(rows, expected=bad)
    other = {**benchmark, "expected_page_count": 13, "expected_stratum_counts": {C.STRATA[0]: 13, C.STRATA[1]: 0}}
    with pytest.raises(ValueError):
        validate.require(rows.withColumn("benchmark_provenance", F.lit(columns.stable_json(other))))


@pytest.mark.parametrize("change", [{"sampler_version": " "}, {"sampler_seed": 1.5}, {"sampler_seed": True}, {"sampler_requested_n": -1}, {"sampler_source_repo": None}, {"sample_stratum_threshold": 3}, {"more": 1}])
def test_sampler_provenance(scored, change):
    truth, benchmark, _ = scored
    good = SAMPLER | {"sample_stratum_threshold": C.STRATUM_THRESHOLD}
    validate.check_benchmark(benchmark | {"sampler_provenance": good})
    with pytest.raises(ValueError):
        validate.check_benchmark(benchmark | {"sampler_provenance": good | change})


def test_sampler_columns(scored):
    truth, _, _ = scored
    stamped = truth.withColumns({k: F.lit(v) for k, v in SAMPLER.items()})
    assert score.benchmark_provenance(stamped, "d", "main", "0" * 40)["sampler_provenance"]["sampler_seed"] == 7
    for bad in (stamped.drop("sampler_seed"), stamped.withColumn("sampler_seed", F.col("page_key").cast("int")), stamped.withColumn("sampler_seed", F.lit("7"))):
        with pytest.raises(ValueError):
            score.benchmark_provenance(bad, "d", None, None)


def test_group_fingerprints(spark):
    rows = [(v, f"p\n\"é{i}") for i in range(200) for v in ("a", "b", None)[: 1 + i % 3]]
    df = spark.createDataFrame(rows, "v string, page_key string").repartition(5)
    got = {r["v"]: r["fingerprint"] for r in columns.group_fingerprints(df, "v").collect()}
    assert got == {v: columns.page_set_fingerprint(df.where(F.col("v").eqNullSafe(F.lit(v)))) for v in ("a", "b", None)}


def test_adaptive_window():
    queue = iter([0, 0, 0, 9, 9, 9, 9, 9, 3, 3])
    window = ingest.AdaptiveWindow(2, 3, 6, 2, lambda: next(queue))
    assert [window.after_answer() for _ in range(10)] == [4, 6, 6, 4, 2, 1, 1, 1, 1, 1]
    for bad in ((0, 1, 2), (3, 1, 2), (1, -1, 2), (1, 1, 2, 0)):
        with pytest.raises(ValueError):
            ingest.AdaptiveWindow(*bad)
    assert list(ingest.ordered_window(lambda x: x * x, iter(range(50)), 3, ingest.AdaptiveWindow(1, 5, 9, 4, lambda: 0))) == [x * x for x in range(50)]
    read = []

    def items():
        for i in range(100):
            read.append(i)
            yield i

    def fails(x):
        if x == 3:
            raise KeyError(x)
        return x

    with pytest.raises(KeyError):
        list(ingest.ordered_window(fails, items(), 2))
    assert len(read) <= 3 + 4 + 1  # read lazily


def test_resume(spark, tmp_path):
    pages = spark.createDataFrame([(str(i), f"{i} p") for i in range(20)], "page_id string, prompt string")
    cache = str(tmp_path / "cache")

    def half(prompt):
        if int(prompt.split()[0]) % 2:
            raise OSError("down")
        return prompt, "stop"

    first = ingest.resume(pages, half, cache, slices=3)
    assert first.where("error is null").count() == 10 and first.count() == 20
    again = ingest.resume(pages, lambda p: ("new " + p, "stop"), cache, slices=3)
    assert {r["page_id"]: r["raw"] for r in again.collect()} == {str(i): ("new " if i % 2 else "") + f"{i} p" for i in range(20)}
    kept = ingest.resume(pages, lambda p: ("never", "stop"), str(cache), retry_errors=False)
    assert kept.where("raw = 'never'").count() == 0
    for bad in (pages.limit(5), pages.union(pages.limit(1))):
        with pytest.raises(ValueError):
            ingest.resume(bad, half, cache)


def test_ranked_parts(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=3).withColumn("t", F.col("id").cast("string"))
    made = ingest.write_ranked_parts(df, str(tmp_path / "p"), 120, first=4).collect()
    files = sorted(glob.glob(str(tmp_path / "p" / "*.parquet")))
    assert len(files) == len(made) == 9 and files[0].endswith("part-r00-00004.parquet")
    assert sorted(pq.read_table(f).num_rows for f in files) == sorted(r["rows"] for r in made) and max(r["rows"] for r in made) == 120
    assert spark.read.parquet(str(tmp_path / "p")).distinct().count() == 1000
    assert sinks.next_part_index(files, 0) == 7


def test_volume_parameters(spark):
    pages = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "page_key string, volume string")
    strict = lambda have: {r["page_key"]: r["parameter"] for r in ingest.with_volume_parameter(pages, {"a": "deu+fra"}, have, "eng").collect()}
    assert strict({"deu", "fra", "eng"}) == {"1": "deu+fra", "2": "eng", "3": "eng"}
    with pytest.raises(ValueError, match="fra"):
        strict({"deu", "eng"})


def test_fit_blocks():
    """Against the rule taken one step at a time."""
    rng = np.random.default_rng(1)
    sizes = [(1, 1), (28, 28), (3072, 2048), (3073, 2048), (1, 900_000), (900_000, 1), (2, 500_000), (10_000, 10_000)] + [tuple(int(2**x) for x in rng.uniform(0, 14, 2)) for _ in range(400)]
    most, least, grid = 3072 * 2048, 1792 * 28, 28
    w, h = (np.array(x) for x in zip(*sizes, strict=True))
    columns_, rows_ = geometry.fit_blocks(w, h, most, least, grid)
    for (a, b), got in zip(sizes, zip(columns_.tolist(), rows_.tolist(), strict=True), strict=True):
        area = a * b
        scale = math.sqrt(most / area) if area > most else math.sqrt(least / area) if area < least else 1.0
        c, r = max(1, round(a * scale / grid)), max(1, round(b * scale / grid))
        while c * r * grid * grid > most and (c > 1 or r > 1):
            if c == 1 or (r > 1 and not abs((c - 1) / r - a / b) < abs(c / (r - 1) - a / b)):
                r -= 1
            else:
                c -= 1
        assert got == (c, r), (a, b)


def test_findable_and_report(spark):
    words = "The quick brown foxes jump over lazy dogs while several careful readers count every single printed word here and nobody else notices".split()
    a, b = " ".join(words), " ".join(reversed(words))
    assert pagetests._similar("abcd", "abcd") == 1.0 and pagetests._similar("abcd", "wxyz") == 0.0 and pagetests._similar("abcd", "abxd") == 0.75
    assert pagetests.findable("lazy dogs", a.lower(), 1.0) and not pagetests.findable("lazy cats!", a.lower(), 0.9)
    assert pagetests.findable("lazy dogz", a.lower(), 0.85, near=0)
    regions = json.dumps([{"label": "text", "text": a, "box": [0, 0, 10, 10]}, {"label": "text", "text": b, "box": [0, 20, 10, 30]}])
    df = spark.createDataFrame([("1", "v", a + "\n" + b, regions)], "page_key string, volume string, text string, regions string")
    tests = pagetests.with_ids(pagetests.generate(df))
    page = pagetests.eyeball_report(tests, 6)
    assert page.startswith("# Page tests") and page.count("《") == 3 + 2 and "## order" in page
    assert pagetests.eyeball_report(tests, 6) == page and "《" not in pagetests.eyeball_report(tests.limit(0), 6)


def test_statistics_of_the_bootstrap(scored):
    _, _, rows = scored
    share = F.col("recall_matched") / F.col("recall_reference")
    got = report.bootstrap_ci(rows, replicates=20, pools=[F.sum("recall_matched").alias("recall_matched"), F.sum("recall_reference").alias("recall_reference")], statistic=share).collect()
    assert {(r["model"], r["lo"], r["hi"]) for r in got} == {("a", 1.0, 1.0), ("b", 1.0, 1.0)}
    draws = [*report.bootstrap_draws(5, 4, 3)]
    assert len(draws) == 4 and all(sum(d) == 5 for d in draws)


def test_rows_of_token_supports(spark):
    rows = [(1, "a b a c", "a a a x"), (2, None, "a"), (3, " a  b ", None), (4, "", ""), (5, "b", "b a b")]
    df = spark.createDataFrame(rows, "k long, r string, o string").coalesce(1)
    got = {r["k"]: (r["matched"], r["reference"], r["output"]) for r in multiset.supports(df, ["k"], F.col("r"), F.col("o")).collect()}
    assert got == {1: (2, 4, 4), 2: (0, 0, 1), 3: (0, 2, 0), 4: (0, 0, 0), 5: (1, 1, 3)}


def test_bands_equal_the_whole_matrix():
    rng = np.random.default_rng(2)
    for n in [*range(2, 60), 400, 900]:
        letters = list(map(chr, rng.integers(97, 100, n)))
        ref, out = "".join(letters), letters
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(out) + 1))
            out[at : at + int(rng.integers(0, 3))] = list(map(chr, rng.integers(97, 100, int(rng.integers(0, 3)))))
        out = "".join(out) or "a"
        steps = align._align_far(ref, out)
        distance = len(ref) - steps[0].count(b"h") + steps[1]
        for width in (3, 8, 30):
            found = align._align_near(ref, out, width)
            assert found == steps if found is not None else distance > width - 2


def test_small_ones(spark):
    labels = spark.createDataFrame([("deu_Latn",), ("zzz_Latn",), (None,)], "l string")
    assert [r[0] for r in labels.select(columns.iso_name(F.col("l"))).collect()] == ["German (deu_Latn)", "zzz_Latn", None]
    pages = spark.createDataFrame([("1", "a\nb"), ("2", None)], "page_id string, text string")
    got = language.predict_pages(pages, lambda texts: [(f"l{len(t)}", 0.5 if "\n" in t else 0.25) for t in texts]).collect()
    assert [(r["label"], r["conf"]) for r in got] == [("l3", 0.25), ("l0", 0.25)]
    order = [r["page_key"] for r in sampling.shuffled(spark.createDataFrame([(str(i),) for i in range(30)], "page_key string"), 3).collect()]
    assert sorted(order, key=int) != order and order == [r["page_key"] for r in sampling.shuffled(spark.createDataFrame([(str(i),) for i in range(30)][::-1], "page_key string").repartition(4), 3).collect()]
    card = sinks.dataset_card("d", {"license": "x", "n": 2}, {"ok": 3, "error": 1})
    assert card.splitlines()[:4] == ["---", 'license: "x"', "n: 2", "---"] and "| error | 1 |" in card
    with pytest.raises(RuntimeError):
        responses.jpeg()
    image = spark.createDataFrame([(bytearray(b"ab"),), (None,)], "i binary")
    assert [r[0] for r in image.select(responses.encoded_url(F.col("i"), lambda b: b * 60)).collect()][0].count("\n") == 0
    with pytest.raises(ValueError):
        responses.with_images(spark.createDataFrame([("x.png",)], "image_path string"), spark.createDataFrame([], "path string, content binary"))
