import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(n=60, seed=3):
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = "\n".join(sentence(30) for _ in range(4))
    texts = []
    for i in range(n):
        text = "\n".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
        if i % 7 == 0:
            text = text + "\n" + passage + "\n" + sentence(5)
        texts.append(text)
    base = sentence(120)
    near = base.split()
    near[50] = "changed"
    texts += [base, base, " ".join(near), "", None, "a", "\n\n\n", "x" * 3000, sentence(4000), "日本語 é 😀 " * 40, "  two  spaces   \n \n", "12 34 ##"]
    rows = [(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a row without an id", "en", None, None), (None, None, None, None, None)]


def thue_morse(n, letters):
    """Words that polynomials modulo 2^64 do not tell from their complements."""
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.fixture(scope="session")
def alike(spark):
    """Two different texts over two letters with equal polynomial hashes, and a copy of one."""
    a, b = thue_morse(4096, "ab"), thue_morse(4096, "ba")
    return spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(spark, rows):
    """The same without repeated and null ids."""
    seen, kept = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            kept.append(r)
    return spark.createDataFrame(kept, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns that bear names which operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("t", "h", "c", "n", "part", "data", "items", "hits", "cid", "row", "score", "__extra", "label", "ids")})
