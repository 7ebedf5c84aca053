"""Every query of the catalogue against DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomlog.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        rows = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert got == sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    else:
        assert got


def test_chunk_numbers_with_gaps_and_repeats(spark, tmp_path):
    rows = spark.range(2500).selectExpr("7 + 3 * (id div 2) as event_id", "timestamp'2024-01-01 00:00:00' as ts", "1L as user_id", "'view' as event_type", "1.0D as value", "'{\"k\": 1}' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, catalogue.queries()["chunk_numbers"](spark, str(tmp_path)).collect())) == [(1, 1000), (2, 1000), (3, 500)]
