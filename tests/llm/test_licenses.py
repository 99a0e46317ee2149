import textwrap

import pytest

from folioscope.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    return L.Model(["the river runs through the town", "a copy of the plan was shown to the people of the city"])


def test_families(model):
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            assert model.classify(t)[0] == family, t
    assert model.classify("Copyright (c) 2024 Someone. Released under the MIT License.")[0] == "mit"
    for t in ["the license of the driver", "Released under the moon", "", "under the", *L._CONFUSABLE]:
        assert model.classify(t) is None, t


@pytest.mark.parametrize("line", ["All rights reserved.", "ALL RIGHTS RESERVED", "Copyright (c) 2019 John Smith. All rights reserved.", "Copyright 2019 Acme Inc. All rights reserved.", "(c) 1987-2003 Regents of the College. All rights reserved.", "Copyright 2011 by Jane Q. Public and others. All rights reserved worldwide."])
def test_reserved_by_anyone(model, line):
    found = model.classify(line)
    assert found and found[0] == "reserved"


@pytest.mark.parametrize("line", ["All rights of the people were read aloud.", "The table was reserved for the authors in 2020.", "Copyright is a branch of law.", "the rights reserved to the states"])
def test_not_reserved(model, line):
    assert model.classify(line) is None


def test_against_one_by_one(spark, model, docs):
    texts = [f"first line\n{t}\nlast line" for ts in L.TEMPLATES.values() for t in ts] + [None, "", "no notice here", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((docs["doc_id"] + 1000).alias("doc_id"), "text"))
    for r in L.scan(df, model).collect():
        want = [(k, *found) for k, line in enumerate((r["text"] or "").split("\n")) if (found := model.classify(line))]
        got = [(n["paragraph"], n["family"], n["score"]) for n in r["notices"]]
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
        assert r["families"] == sorted({x[1] for x in want})


@pytest.mark.parametrize(("width", "mark"), [(70, ""), (80, ""), (72, "# "), (40, " * ")])
def test_wrapped_headers(spark, model, width, mark):
    texts = [(f, t) for f, ts in L.TEMPLATES.items() for t in ts if len(t) > width]
    rows = []
    for k, (_, t) in enumerate(texts):
        body = [mark + x for x in textwrap.wrap("Some words first. " + t + " And some after it.", width)]
        rows.append((k, "\n".join(["code = 1", "", *body, "", "more = 2"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["notices"] for r in L.scan(df, model).collect()}
    for k, (family, t) in enumerate(texts):
        assert {n["family"] for n in found[k]} == {family}, t


def test_wrapped_between(spark, model):
    """Not over lines without words; two notices that share a line; a line that is one by itself."""
    bsd = textwrap.wrap(L.TEMPLATES["bsd"][0], 75)
    mit = textwrap.wrap(L.TEMPLATES["mit"][2] + " " + L.TEMPLATES["mit"][3], 75)
    texts = ["\n\n".join(bsd), "\n".join(mit), "\n".join(["All rights reserved.", *bsd]), "\n".join(bsd + ["", *bsd])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(n["paragraph"], n["family"]) for n in r["notices"]] for r in L.scan(df, model).collect()}
    assert got[0] == [] and got[2] == [(0, "reserved"), (1, "bsd")]
    assert [f for _, f in got[1]] == ["mit", "mit"]
    assert got[3] == [(0, "bsd"), (len(bsd) + 1, "bsd")]


def test_odd_tables_and_native(model, none, clashing):
    assert L.scan(none, L.train(none)).count() == 0
    out = L.scan(clashing, model)
    assert out.count() == clashing.count()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("width", [72, 50])
def test_recall_of_wrapped_notices(spark, width):
    """Every template with other years and holders, wrapped as headers are, between other lines; clean texts have none."""
    rows, want = [], {}
    for family, texts in L.TEMPLATES.items():
        for text in texts:
            notice = text.replace("2020 The Authors", "2011-2019 Example Corp")
            lines = ["The river runs to the sea.", *textwrap.wrap(notice, width), "", "Many words of another kind follow here."]
            want[len(rows)] = family
            rows.append((len(rows), "\n".join(lines)))
    clean = ["The permission of the owner was granted for the use of the field.", "All rights of way are kept.\nThe source of the river is free to any person."]
    rows += [(1000 + i, t) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in L.scan(df, L.train(df)).collect()}
    found = sum(f in got[i] for i, f in want.items())
    assert found >= 0.9 * len(want), [(i, f, got[i]) for i, f in want.items() if f not in got[i]]
    assert not any(got[1000 + i] for i in range(len(clean)))
