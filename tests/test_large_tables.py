"""What shows on tables of several files, long texts and large batches only."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import align, batches, columns
from folioscope.operators import pagetests, score
from folioscope.plans import fixtures as X
from folioscope.plans import report_queries, transform_queries


def _lines(spark, folder, files=4):
    """Order lines in several files; each key is in every file, with other values."""
    for n in range(files):
        k = F.col("id")
        rows = spark.range(500).select((k % 100).alias("l_orderkey"), (1 + k % 5).cast("int").alias("l_linenumber"), F.element_at(F.array(*map(F.lit, "ANR")), ((k + n) % 3 + 1).cast("int")).alias("l_returnflag"), (1.0 + (k * 7 + n) % 50).alias("l_quantity"), (k + 100 * n).alias("l_suppkey"))
        rows.coalesce(1).write.parquet(f"{folder}/raw-{n}")
        (part,) = [p for p in (folder / f"raw-{n}").iterdir() if p.name.startswith("part-")]
        (folder / "lineitem.parquet").mkdir(exist_ok=True)
        # Later files are larger, so they are read first.
        part.rename(folder / "lineitem.parquet" / f"{n}.parquet")
    return str(folder)


def test_cards_are_made_of_the_first_line_of_each_key(spark, tmp_path):
    folder = _lines(spark, tmp_path)
    found = X.first_rows(X.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey"]).collect()
    assert len(found) == 100 and all(r["l_suppkey"] < 100 and r["l_suppkey"] == r["l_orderkey"] for r in found)
    cards = X.cards(spark, folder).select("page_id", "model", "recall_reference").collect()
    assert sorted(tuple(r) for r in cards) == sorted((f"{k}-{1 + k % 5}", "ANR"[k % 3], 1 + k * 7 % 50) for k in range(100))


def _slow_counts(ref, out):
    """The whole matrix; from the end a deletion first, then an insertion."""
    cost = [[*range(len(out) + 1)]]
    for i, a in enumerate(ref, 1):
        cost.append([i])
        for j, b in enumerate(out, 1):
            cost[i].append(min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a != b)))
    i, j, s, d, n = len(ref), len(out), 0, 0, 0
    while i and j:
        if cost[i][j] == cost[i - 1][j] + 1:
            i, d = i - 1, d + 1
        elif cost[i][j] == cost[i][j - 1] + 1:
            j, n = j - 1, n + 1
        else:
            i, j = i - 1, j - 1
            s += ref[i] != out[j]
    return s, d + i, n + j, len(ref) - s - d - i


def test_alignments_pass_equal_stretches_and_keep_their_counts():
    rng = random.Random(3)
    text = " ".join(rng.choice("the other word then weather a thesis".split()) for _ in range(60))
    for ref, out in [(text, text.replace("the", "teh")), (text, "head line " + text.replace("the", "teh")), (text, text[:100] + text[140:].replace("o", "0")), (text + "ab", "ba" + text), (text, text.replace("e", "ø")), (text, text.replace("e", "")), (text, text.replace("e", "eø"))]:
        assert align._align_near(ref, out, 120) in (None, align._align_far(ref, out))
        a, b = ref, out
        while a and b and a[0] == b[0]:
            a, b = a[1:], b[1:]
        same = len(ref) - len(a)
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        s, d, n, h = _slow_counts(a, b)
        assert align.edit_counts(ref, out) == (s, d, n, len(ref) - s - d) and h <= len(ref) - same


def test_near_texts_take_time_by_their_edits():
    ref = " ".join(f"word{i} lorem ipsum" for i in range(7000))
    began = time.process_time()
    assert align.edit_counts(ref, ref.replace("e", "ø"))[0] == ref.count("e")
    assert align.edit_counts(ref, ref.replace("m", ""))[1] == ref.count("m")
    assert align.edit_counts("x" + ref, ref + "y") == (0, 1, 1, len(ref))
    assert time.process_time() - began < 3


def test_batches_are_taken_in_pieces_of_bounded_bytes(spark):
    texts = pa.array(["x" * 700_000, None, "", "y" * 3_000_000, "ü" * 200_000, *["z" * 1000] * 5000])
    found = [*batches.pieces(texts, pa.array([None] * 5005, pa.string()))]
    assert [at for at, _ in found] == [0, *(sum(n for _, n in found[:k]) for k in range(1, len(found)))] and sum(n for _, n in found) == 5005
    sizes = [sum(len((t or "").encode()) for t in texts.slice(at, n).to_pylist()) for at, n in found]
    assert all(n <= batches.MOST_BYTES or rows == 1 for n, (_, rows) in zip(sizes, found, strict=True))
    # How much a function gets at once does not grow with the batch.
    most = batches.text_map(T.LongType())(lambda rows: [sum(map(len, rows))] * len(rows))
    rows = spark.range(4000).coalesce(1).select(F.repeat(F.lit("a"), 2000).alias("t"))
    assert rows.select(most("t").alias("n")).agg(F.max("n")).first()[0] <= batches.MOST_BYTES


def test_snippets_whose_pieces_occur_once_need_no_alignment(monkeypatch):
    rng = random.Random(4)
    words = [rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.randrange(9999)) for _ in range(300)]
    page = " ".join(words)
    cut = [" ".join(words[k : k + 7]) for k in range(0, 290, 5)]
    wanted = [pagetests.distinct_starts(pagetests.places(s, page, pagetests.max_diffs(len(s), 0.04)), len(s)) for s in cut]
    monkeypatch.setattr(align, "find_within", None)
    monkeypatch.setattr(pagetests, "_similar", None)
    for s, starts in zip(cut, wanted, strict=True):
        assert [pagetests.only_place(s, page, pagetests.max_diffs(len(s), 0.04))] == starts
        assert pagetests.findable(s, page, 0.96, starts[0])


def test_trimmed_characters_are_those_of_the_pattern(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c) + "a" + chr(c) + "b" + chr(c),) for c in codes], "t string")
    assert rows.where(~columns.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", f"^{columns.SPACE}+|{columns.SPACE}+$", ""))).isEmpty()
    # Long texts: a pattern would look at every character of them.
    assert "regexp" not in rows.select(columns.strip(F.col("t")).alias("s"))._jdf.queryExecution().toString()


def test_chains_make_the_bare_text_of_a_page_once(spark, tmp_path):
    spark.createDataFrame([(i, f"Page {i}: two words, three!") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = transform_queries.chains(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9]+") <= 2  # once for chains of expressions, once for those in Python
    assert made.count() == 5 * 17


def test_pooled_rates_pass_over_the_lines_once(spark, tmp_path):
    folder = _lines(spark, tmp_path, 2)
    plan = report_queries.pooled_rates(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_cards_are_written_without_columns_that_nobody_reads(spark, tmp_path, monkeypatch):
    folder, seen = _lines(spark, tmp_path, 2), []
    keep = report_queries.written
    monkeypatch.setattr(report_queries, "written", lambda df, kind: seen.append(df.columns) or keep(df, kind))
    assert report_queries.bootstrap_intervals(spark, folder).count() == 3
    assert len(seen) == 1 and not {"region_global_token_recall", "cer_diplomatic", "score_provenance"} & set(seen[0])


def test_pages_within_their_outputs_need_no_alignment(monkeypatch):
    monkeypatch.setattr(align, "operations", None)
    text = "Head line\n" + "some words of a page " * 40
    found = score.page_counts(text, text.partition("\n")[2], "Head line", None, text + text[-20:] * 12)
    assert [found[f"cer_body_dip_{x}"] for x in "sdi"] == [0, 0, 10 + 12 * 20] and found["cer_full_dip_i"] == 12 * 20
