import pyarrow as pa
import pytest

from tests.check import compare, duck
from tests.llm.conftest import SF
from tidemark.llm import licences, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_licence_sql_knows_whole_texts(spark):
    """One document for each whole licence, which the given tables lack."""
    import duckdb

    texts = [path.read_text(encoding="utf-8") for path in sorted(licences.TEXTS.glob("*.txt"))]
    docs = [(i, t) for i, t in enumerate([*texts, *["MIT License\n\n" + t.upper() for t in texts], "prose\nReleased under the MIT License.\nprose", "", None])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.string())}))
    found = {r["doc_id"]: (r["text_digest"], r["text_licence"], ",".join(r["line_licences"]), r["licence_lines"]) for r in licences.scan(frame, licences.known_licences(spark)).collect()}
    rows = con.execute(queries.oracle_sql()["op4_licence_digests"])
    names = [d[0] for d in rows.description]
    theirs = {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in ("text_digest", "text_licence", "line_licences", "licence_lines")) for r in rows.fetchall()}
    assert found == theirs and all(found[i][1] for i in range(len(texts)))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
