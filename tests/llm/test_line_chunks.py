from collections import defaultdict

from pyspark.sql import functions as F

from folioscope.llm import line_chunks as L


def chunks(text):
    import hashlib

    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        roll = ((h[i - 1] % L.PRIME * L.BASE if i else 0) + h[i]) % L.PRIME
        if roll % 3 == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    places = defaultdict(set)
    for i, t in rows:
        for k, c in enumerate(chunks(t)):
            if len(c) > 1 and "".join(c).strip(" \t\r"):
                places["\n".join(c)].add((i is not None, i or 0, t or "", k))
    want = []
    for i, t in rows:
        stay = [c for k, c in enumerate(chunks(t)) if not (len(c) > 1 and len(places["\n".join(c)]) > 1 and min(places["\n".join(c)]) != (i is not None, i or 0, t or "", k))]
        want.append((str(i), None if t is None else "\n".join("\n".join(c) for c in stay), len((t or "").split("\n"))))
    got = [(str(r["doc_id"]), r["text"], r["n_lines"]) for r in L.drop_repeated_chunks(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(t != o for (_, t, _), (_, o) in zip(want, rows, strict=True))


def test_shift_resistance(spark):
    shared = "\n".join(f"line {i} of the passage" for i in range(30))
    df = spark.createDataFrame([(1, "own a\n" + shared), (2, "own b\nother\n" + shared + "\nend")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.drop_repeated_chunks(df).collect()}
    assert got[1]["removed_chunks"] == 0 and got[2]["removed_lines"] > 8 and got[2]["text"].startswith("own b\nother")


def test_empty_clashing_and_native(none, clashing):
    assert L.drop_repeated_chunks(none).count() == 0
    out = L.drop_repeated_chunks(clashing.withColumn("n_lines", F.lit("old")))
    assert out.schema["n_lines"].dataType.simpleString() == "bigint" and out.count() == clashing.count()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_passages(spark):
    """Runs of 50 words or more between foreign lines, long single lines and short runs."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    run = [line("a", 30), "", line("b", 12), line("c", 20)]
    texts = ["\n".join(["own one", *run, "end one"]), "\n".join(["own two", line("x", 60), *run, "end two"]), "\n".join([line("x", 60), "end three"]), "\n".join(["four", line("a", 30), "end"]), line("x", 60)]
    got = dict(L.drop_repeated_passages(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")).collect())
    assert got[0] == texts[0] and got[1] == "\n".join(["own two", line("x", 60), "", "end two"]) and got[2] == "end three"
    assert got[3] == texts[3] and got[4] == texts[4] and got[5] is None
