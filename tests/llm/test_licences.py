import hashlib

from tests.llm.conftest import odd_rows
from tidemark.llm import licences


def scan(spark, texts, known=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licences.scan(docs, known if known is not None else licences.known_licences(spark)).collect()
    return {r["doc_id"]: r for r in rows}


def test_equivalent_texts_have_one_digest(spark):
    got = scan(spark, [
        "Released under the MIT License.", "  RELEASED under the MIT\tLicence!", "Copyright (c) 2020 Someone\nReleased under the MIT License", "(C) 1999 x\n© y\n\nreleased, under the mit license",
        "Released under the MIT License. And more", "prose\nReleased under the MIT license\nprose\nLicensed under CC BY-NC 4.0\nReleased under the MIT License.",
    ])
    assert [got[i]["text_licence"] for i in range(6)] == ["MIT"] * 4 + [None, None]
    assert got[0]["text_digest"] == hashlib.sha256(b"released under the mit license").hexdigest() and len({got[i]["text_digest"] for i in range(4)}) == 1
    assert got[5]["line_licences"] == ["CC-BY-NC-4.0", "MIT"] and got[5]["licence_lines"] == 3


def test_odd_rows(spark, odd, nothing):
    known = licences.known_licences(spark)
    rows = licences.scan(odd, known).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["text_digest"] is None for r in rows if r["doc_id"] in (4, 5, 6))
    assert licences.scan(nothing, known).count() == 0
    assert all(r["text_licence"] is None and r["licence_lines"] == 0 for r in licences.scan(odd, known.limit(0)).collect())


def test_ties_and_empty_known_texts(spark):
    known = spark.createDataFrame([("B", "same text"), ("A", "Same, text"), ("C", None), ("D", "!!")], "licence string, text string")
    got = scan(spark, ["same  text", None, "!!"], known)
    assert [got[i]["text_licence"] for i in range(3)] == ["A", None, None]


def test_plan_has_no_python(spark, odd):
    plan = licences.scan(odd, licences.known_licences(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "Arrow" not in plan


def test_whole_licences(spark):
    bodies = {p.stem: p.read_text(encoding="utf-8") for p in licences.TEXTS.glob("*.txt")}
    names = sorted(bodies)
    texts = [bodies[n] for n in names]
    flat = ["\n\n".join(" ".join(part.split()) for part in t.split("\n\n")) for t in texts]
    headed = ["MIT License\n\nCopyright (c) 2020 A. Body\n\n" + bodies["MIT"], "Copyright 2021 B\nAll rights reserved" + bodies["ISC"], bodies["Apache-2.0"].split("APPENDIX")[0]]
    got = scan(spark, texts + flat + headed + [t + " and more" for t in texts])
    expected = [n.removesuffix(".University") for n in names]
    assert [got[i]["text_licence"] for i in range(2 * len(names))] == expected * 2 and len(names) >= 20
    rest = [got[i]["text_licence"] for i in range(2 * len(names), len(got))]
    assert rest == ["MIT", None, "Apache-2.0"] + [None] * len(names)
