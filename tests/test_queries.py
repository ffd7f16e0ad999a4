"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(repr, (tuple(None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else float(x) if isinstance(x, float) else x for x in r) for r in df)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(catalog.oracle_sql()[name])
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert rows(got.select(*columns).collect()) == rows(tuple(r[i] for i in order) for r in want.fetchall())


def test_vector_table_multiplies_in_floats(spark, tmp_path):
    """Whole thousandths, other numbers of both signs, and vectors that are empty, null or hold a null."""
    values = np.concatenate([np.arange(-1000, 1001) / 1000, np.random.default_rng(1).normal(0, 0.2, 2000)]).astype(np.float32)
    vectors = pa.array([*([v, 1.0] for v in values.tolist()), [], None, [None]], pa.list_(pa.float32()))
    ids = pa.array(range(len(vectors)), pa.int64())
    pq.write_table(pa.table({"vec_id": ids, "embedding": vectors, "label": ids.cast(pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, label, n, first_value FROM ({catalog.oracle_sql()['vector_table']})").fetchall()
    got = catalog.queries()["vector_table"](spark, str(tmp_path)).select("vec_id", "label", "n", "first_value").collect()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
