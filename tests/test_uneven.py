"""Queries over images that have fewer blocks or contours than others, against their SQL."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Vectors of which every eighth part has one to eight."""
    folder = tmp_path_factory.mktemp("uneven")
    duckdb.connect().execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < 128 AND vec_id % 8 <= vec_id // 8 % 8) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["s04_jpeg", "v00_dorsal_cells", "v03_outline_cells"])
def test_agrees_with_sql(spark, uneven, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{uneven}/embeddings.parquet'")
    df = __spark_entry__.queries()[name](spark, uneven)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    rows = lambda rs: sorted(tuple("null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rs)
    assert rows(df.select(*columns).collect()) == rows(found)
