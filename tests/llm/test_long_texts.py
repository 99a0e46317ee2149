"""Texts longer than one pass of any operator."""

import random

import public_tokenizers
import pytest
import sentencepiece

from folioscope.llm import decontaminate, fingerprints, jaccard_join, language_id, line_chunks, piece_codec, suffix_repeats, token_store


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(90_000)]
    long = "\n".join(lines)
    assert len(long) > 6 << 20
    return {1: long, 2: long[: len(long) - 40], 3: "x " + long[5_000_000:5_001_000], 4: "short"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").repartition(4)


def test_repeats(docs, texts):
    got = {r["doc_id"]: r for r in suffix_repeats.remove_repeats(docs, 400).collect()}
    assert {i: bytes(r["kept"]).decode() for i, r in got.items()} == {1: texts[1][-40:], 2: "", 3: "x ", 4: "short"}


def test_links_and_hits(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(docs, 3, 90, 100).collect()}
    words = texts[1].split()
    assert got[1] == (len(set(zip(words, words[1:], words[2:], strict=False))), 1) and got[2][1] == 1 and got[3][1] == 3
    items = spark.createDataFrame([(7, " ".join(words[-13:])), (8, texts[4])], "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_contamination(docs.select("doc_id", "text"), items).collect()}
    assert found[1] == (len(words), 13, ["7"]) and found[2][1] == 0 and found[4] == (1, 1, ["8"])


def test_tokens(docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_codec.round_trip(docs, path, ["doc_id"]).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
    got = {r["doc_id"]: r for r in token_store.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got[i + 1]["start"] - got[i]["start"] - got[i]["n_tokens"] for i in (1, 2, 3)] == [0, 0, 0] and got[1]["n_tokens"] > 1 << 20


def test_lines_languages_and_digests(docs, texts):
    got = {r["doc_id"]: r for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert got[1]["text"] == texts[1] and got[1]["n_lines"] == 90_000 and len(got[2]["text"]) < len(texts[2]) // 5  # chunks of one line stay
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"en"}
    marks = {r["doc_id"]: fingerprints.from_text(r["fingerprint"])[None] for r in fingerprints.fingerprint(docs).collect()}
    assert fingerprints.likeness(marks[1], marks[2])[0] > 0.95 > 0.6 > fingerprints.likeness(marks[1], marks[4])[0]
