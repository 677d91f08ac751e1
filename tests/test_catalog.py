"""Every registered query: those with SQL against DuckDB, and the entry points."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from octoloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(same_as_sql, name):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


def test_colour_sums_of_empty_and_repeated_documents(spark, tmp_path):
    """One row for all texts of an id, null ids too, and none where there is no byte."""
    import duckdb

    texts = [(1, "abc"), (2, ""), (3, None), (4, "dup one"), (4, "dup tw\u00f6"), (5, ""), (5, "x"), (None, "\x00\x7f\u00ff"), (None, "a"), (6, "\t\U0001f600")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        expected = con.execute(catalog.ORACLES["byte_class_rgb"]).fetchall()
    got = catalog.QUERIES["byte_class_rgb"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 4, 5, 6]


def test_entry_and_names(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """As after their folders are deleted."""
    import os
    import shutil

    root = os.path.dirname(entry_points.__file__)
    shutil.copytree(f"{root}/octoloom", tmp_path / "octoloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
