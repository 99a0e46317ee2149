import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import token_store as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_coding(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)
    control, data = T.pack(values)
    assert len(control) == -(-n // 4) and (T.unpack(control, data, n) == values).all()


def test_pieces_equal_the_library():
    import random

    import pyarrow as pa

    rng = random.Random(2)
    parts = ["a", "b", "the", "ing", "'s", " ", "  ", "\n", "\t", "é", "日", "😀", "1", "23", ".", "!!", " \n", " ", "　", "word", "<|endoftext|>"]
    texts = ["", None, " ", "  "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    encoder = T.ByteEncoder(PATH)
    ids, counts = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def with_small_stores(keep):
    encoder = T.ByteEncoder(PATH)
    for store in vars(encoder).values():
        if hasattr(store, "keep"):
            store.keep = keep
    return encoder


def test_full_stores_keep_frequent_words():
    encoder, asked = with_small_stores(100), []

    class Model:
        def tokenize(self, part, model=encoder.model):
            asked.append(part)
            return model.tokenize(part)

    encoder.model = Model()
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 9))
    common = ["often"] + [word() for _ in range(20)]
    texts = ["x " + " ".join([*common, "often.", "Often,", *(word() for _ in range(30))]) for _ in range(40)]
    for text in texts:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids
        assert max(len(s.slot) for s in vars(encoder).values() if hasattr(s, "slot")) < 200
    # Each word once, also the frequent ones, though the store was full many times.
    assert len(asked) == len(set(asked)) > 1000


@pytest.mark.parametrize("keep", [0, 3, 40, 2000])
def test_small_stores_equal_the_library(keep):
    rng = np.random.default_rng(keep)
    parts = ["a", "b", "the", "ing", "'s", "'", "s", " ", " ", " ", "\n", "\t", "é", "日", "😀", "1", "23", ".", ",", "!!", "\x7f", "\u2028", "Ġ", "ª", "٣", "<|endoftext|>"]
    encoder = with_small_stores(keep)
    for _ in range(60):
        texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(20)]
        ids, counts = encoder.encode(pa.array(texts))
        want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("block", [1 << 21, 500])
def test_round_trip(docs, block, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", block)
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    files = [tuple(r) for r in T.write(docs, PATH).collect()]
    got = T.read(docs.sparkSession, files, with_ids=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_odd_tables(none, clashing):
    assert T.write_and_read(none, PATH).count() == 0
    assert T.write_and_read(clashing, PATH).count() == clashing.count()
