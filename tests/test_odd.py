"""Queries over odd and long rows, and more of them than a cap left, which the small tables don't have; against their SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

from quarry.plans import catalogue, more  # noqa: F401

LINE = "x" * 25_000
TEXTS = [None, "", " ", "\n\t", "\x0b", "\x0c", " ", "\x1c", "\u0085", "a\x0b", "\U0001f600 x", f"{LINE}\n\n\n\n\n\n{LINE}", f"{LINE}\n\n\n{LINE}", LINE * 21, "plain words"]


def differences(spark, folder, name):
    """Rows that only the query has, rows that only its SQL has."""
    docs = [(i * 10 + j, t, lang, "src1", len(t or "")) for i, t in enumerate(TEXTS) for j, lang in enumerate(("en", "de", "fr", "es", None))]
    docs += [(None, "a text without a number", "en", None, 23)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    ours = catalogue.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        columns = ", ".join(f'"{n}"' for n in ours.columns)
        theirs = Counter(c.execute(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    got = Counter(tuple(r) for r in ours.collect())
    return got - theirs, theirs - got


@pytest.mark.parametrize("name", ["indexable_files", "language_share", "plugin_chunks"])
def test_odd_documents(spark, tmp_path, name):
    assert differences(spark, tmp_path, name) == ({}, {})


def test_references_are_all_returned(spark, tmp_path):
    rows = [(i, [1.0, 1.0 + i / 1000], 0) for i in range(460)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.src, r.dst) for r in catalogue.graph_references(spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(f"SELECT src, dst FROM ({catalogue.oracle_sql()['graph_references']})").fetchall()
    assert got == set(want) == {(a, b) for b in (300, 400, 450) for a in range(b)} and len(want) == 1150
