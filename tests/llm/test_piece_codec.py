import random

import public_tokenizers
import pytest
import sentencepiece

from folioscope.llm import piece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(library):
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "b", "e", "th", "in", "▁", " ", "  ", "\n", "é", "日", "😀", "ing", "er", "1", "23", ".", "the "]
    texts = ["", None, " ", "a ", "▁▁ a", "\n\n a\n", "\x00a\x01", "a" * 3000, " " * 3000 + "x", "<0x0A> <s> </s>", "�"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    encoder = C.Encoder(PATH)
    ids = encoder.encode(pa.array(texts))
    assert ids.to_pylist() == library.encode([t or "" for t in texts])
    assert encoder.model.decode_lists(ids).to_pylist() == library.decode(ids.to_pylist())
    drawn = [[rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randint(0, 12))] for _ in range(1500)]
    assert encoder.model.decode_lists(pa.array(drawn, pa.list_(pa.int32()))).to_pylist() == library.decode(drawn)


def test_tables(docs, none, clashing, library):
    for r in C.round_trip(docs, PATH, ["doc_id", "text"]).collect():
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == library.decode(r["ids"])
    assert C.round_trip(none, PATH, ["doc_id"]).count() == 0
    ids = C.encode(clashing.drop("ids"), PATH, ["doc_id", "__extra"])
    assert C.decode(ids, PATH, ["doc_id"]).count() == clashing.count()


def test_long_words(library):
    """Words on both sides of LONG_WORD, with pieces that go on merging and without."""
    import pyarrow as pa

    rng = random.Random(7)
    parts = ["th", "and", "an", "te", "de", "ion", " ", "  ", "日", "本", "é"]
    texts = [c * n for c in ("a", "ab", "th", "ha", "=-", " ") for n in (C.LONG_WORD // 2, C.LONG_WORD, C.LONG_WORD + 1, 2500)]
    texts += ["".join(rng.choice(parts) for _ in range(3000)) for _ in range(5)] + ["".join(chr(rng.randrange(97, 123)) for _ in range(n)) for n in (1023, 1024, 1025, 30_000)]
    texts += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(4000))]
    assert C.Encoder(PATH).encode(pa.array(texts)).to_pylist() == library.encode(texts)
