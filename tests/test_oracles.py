"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from holdfast.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = oracle.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert _sorted(df.select(*columns).collect()) == _sorted(want)
