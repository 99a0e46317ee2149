import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language_id as G

WORDS = {"en": "the of and that with this from have which".split(), "de": "der die und nicht mit über schön für auch".split(), "es": "el la que los niño año para como más".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 40))), lang) for i in range(400) for lang in [rng.choice(list(WORDS))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "the and of", None), (None, "der und die", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(corpus):
    model = G.fit(corpus)
    rows = G.predict(corpus, model).withColumn("held", G.held_out()).collect()
    held = [r for r in rows if r["held"] and r["lang"] and r["text"]]
    assert len(held) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in held if len(r["text"]) > 10]) > 0.95
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_training_ignores_held_out_labels(corpus):
    scrambled = corpus.withColumn("lang", F.when(G.held_out(), "xx").otherwise(F.col("lang")))
    a, b = G.fit(corpus), G.fit(scrambled)
    assert b.labels == a.labels and np.allclose(a.weights, b.weights)


def test_scores_equal_sums(corpus):
    import pyarrow as pa

    model = G.fit(corpus)
    text = "Der Año the und"
    slots, _, _ = G.grams(pa.array([text]))
    found = np.concatenate(slots)
    found = found[found < G.SLOTS]
    want = model.bias + 100.0 * model.weights[found].astype(float).sum(axis=0) / len(found)
    assert np.allclose(model.logits(pa.array([text]))[0][0], want, atol=1e-3)


def test_odd_tables(none, clashing):
    model = G.fit(none)
    assert model.labels == [] and G.predict(none, model).count() == 0
    out = G.predict(clashing, G.fit(clashing))
    assert out.count() == clashing.count() and dict(out.dtypes)["score"] == "double"


def test_label_of_long_documents_only(spark):
    rows = [(i, "the river runs through the town " * 5, "en") for i in range(60)] + [(100 + i, "der fluss strömt durch die stadt " * 700, "de") for i in range(12)]
    model = G.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.labels) == ["de", "en"]


def test_small_shares(spark):
    """A share below one millionth still takes rows, and the same rows as a larger one takes."""
    from pyspark.sql import functions as F

    from folioscope.llm._common import in_share

    df = spark.createDataFrame([(-(2**63),), (-(2**63) + 10**9,), (0,), (2**63 - 1,)], "h long")
    got = [df.where(in_share(F.col("h"), s)).count() for s in (0.0, 1e-12, 1e-9, 0.4, 0.6, 1.0)]
    assert got == [0, 1, 2, 2, 3, 4]


def naive_slots(text):
    """N-grams of one to three characters, one at a time; a text has one character of its own at its end."""
    chars = [c if c.isalpha() else " " for c in text.lower() + "\n"]
    out = []
    for n in range(1, G.ORDERS + 1):
        for i in range(len(chars) - n):
            h = 0
            for k, c in enumerate(chars[i : i + n]):
                code = (ord(c) * 0x9E3779B1) % 2**32
                h = code if k == 0 else (h * 0x01000193) % 2**32 ^ code
            out.append((((h ^ h >> 15) * (0x85EBCA6B + 2 * n)) % 2**32) >> (32 - G.BITS))
    return out


def test_training_one_by_one():
    """TF-IDF, FTRL with both penalties and the temperature, with dictionaries and loops."""
    import math
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(2, 9))) for lang in "en de es".split() * 12]
    labels = "en de es".split() * 12
    for i in range(0, len(labels), 5):  # some wrong ones, so that the best temperature is not an end
        labels[i] = rng.choice("en de es".split())
    slots = [naive_slots(t) for t in texts]
    frequency = Counter(s for found in slots for s in set(found))
    dense = np.zeros(G.SLOTS, np.int64)
    dense[list(frequency)] = list(frequency.values())
    alpha, beta, l1, l2, epochs, apart = 0.5, 1.0, 0.001, 0.001, 3, 5
    model = G.train(texts, labels, dense, len(texts), alpha, beta, l1, l2, epochs, apart)
    names = sorted(set(labels))
    idf = lambda s: math.log((1 + len(texts)) / (1 + frequency[s])) + 1
    rows = [{s: 100 * n / len(found) * idf(s) for s, n in Counter(found).items()} | {"bias": 1.0} for found in slots]
    z, n = {}, {}

    def weight(key):
        pull = z.get(key, 0.0)
        return 0.0 if abs(pull) <= l1 else -(pull - math.copysign(l1, pull)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    def shares(row, t=1.0):
        sums = [sum(x * weight((s, k)) for s, x in row.items()) / t for k in names]
        e = [math.exp(v - max(sums)) for v in sums]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation([i for i in range(len(rows)) if i % apart]).tolist():
            gone = shares(rows[i])
            old = {(s, k): weight((s, k)) for s in rows[i] for k in names}
            for s, x in rows[i].items():
                for k, p in zip(names, gone, strict=True):
                    g = x * (p - (k == labels[i]))
                    before = n.get((s, k), 0.0)
                    z[s, k] = z.get((s, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old[s, k]
                    n[s, k] = before + g * g
    held = [i for i in range(len(rows)) if i % apart == 0]
    loss = lambda t: -sum(math.log(max(shares(rows[i], t)[names.index(labels[i])], 1e-12)) for i in held)
    assert loss(model.temperature) <= min(loss(0.05 * 400 ** (j / 40)) for j in range(41)) + 1e-2
    got, score = model.predict(pa.array(texts))
    want = [shares(r, model.temperature) for r in rows]
    assert got == [names[max(range(3), key=w.__getitem__)] for w in want]
    assert np.allclose(score, [max(w) for w in want], atol=2e-3)
