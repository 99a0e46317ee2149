import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from folioscope.llm import decontaminate, jaccard_join, language_id, line_chunks, queries


@pytest.fixture(scope="module")
def folder(unique_docs, spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf").as_uri()
    leak = " ".join(rows[11][1].split()[:20])
    unique_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    for name, stage in P.STAGES:
        after = stage(spark, docs, folder).cache()
        if name == "language ID":
            pred = language_id.predict(docs, language_id.fit(docs))
            want = {r["doc_id"] for r in pred.collect() if r["lang_pred"] != "und" and r["score"] >= P.MIN_LANGUAGE_SCORE}
        elif name == "line dedup":
            want = {r["doc_id"] for r in line_chunks.drop_repeated_chunks(docs).collect() if not r["removed_chunks"] or r["text"].strip(" \n\t\r")}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "n-gram Jaccard join":
            want = {r["component_id"] for r in jaccard_join.similar_groups(docs).collect()}
        elif name == "benchmark decontamination":
            found = decontaminate.find_contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
            want = {r["doc_id"] for r in found if not any(h["end"] - h["start"] >= P.WINDOW for h in r["hits"])}
            assert 11 not in want
        else:
            want = {r["doc_id"] for r in docs.collect()}
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in after.collect())
        assert {r["doc_id"] for r in after.collect()} == want and after.count() == len(want)
        if name != names[-1]:
            assert after.columns == P.COLUMNS
        docs = after


def test_run_and_empty(spark, folder, none, tmp_path):
    assert P.run(spark, folder).count() > 10
    empty = tmp_path.as_uri()
    none.write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, empty).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11))
    assert F is not None


def test_leaks(spark, tmp_path):
    """Whole windows and a twentieth of a document's words drop it; other hits of short items are cut."""
    item, short = " ".join(f"bench{i}" for i in range(15)), "short item"
    own = " ".join(f"é{i}" for i in range(400))
    folder = tmp_path.as_uri()
    spark.createDataFrame([(1, item), (2, short)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = [f"{own}, {item.upper()}! {own}\n{item}", own, f"{short} a few words", None, f"{own}, Short-Item! {own}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in P.drop_leaks(spark, docs, folder).collect()}
    assert set(got) == {1, 3, 4} and got[4]["text"] == f"{own}, ! {own}" and got[4]["n_chars"] == len(got[4]["text"])
    assert got[1]["text"] == own and got[3]["text"] is None


def test_stages_of_odd_rows(spark, docs, clashing, folder):
    """Repeated rows, null ids and texts, clashing columns."""
    for table in (docs, clashing):
        for _, stage in P.STAGES[:-1]:
            table = stage(spark, table, folder).cache()
            assert table.columns == P.COLUMNS
        kept = table.collect()
        assert "a row without an id" in {r["text"] for r in kept if r["doc_id"] is None}
        assert len({r["doc_id"] for r in kept if r["doc_id"] is not None}) == len([r for r in kept if r["doc_id"] is not None])
        assert P.encode_pieces(spark, table, folder).count() == len(kept)
