"""The driver contract, with and without the optional subpackage."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "image_id"


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("flintframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "flintframe.llm", None)
    try:
        plain = importlib.reload(__spark_entry__)
        assert "p07_scar_summary" in plain.queries() and not any(k.startswith("op") for k in plain.queries())
        assert set(plain.oracle_sql()) <= set(plain.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", [n for n in sorted(__spark_entry__.oracle_sql()) if not n.startswith("op")])
def test_agrees_with_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    plain = lambda x: "null" if x is None else f"{x + 0.0:.6g}" if isinstance(x, float) else str(x)
    rows = lambda rs: sorted(tuple(plain(x) for x in r) for r in rs)
    assert rows(df.select(*columns).collect()) == rows(found)
