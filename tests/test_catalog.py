from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) == set(ORACLES)


@needs_data
def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["date", "rank", "ticker", "mom_1m_z", "tbill_rate"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["price_panel", "asof_macro", "transition_matrix", "backtest_summary"])
def test_query_matches_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    mine = entry_points.queries()[name](spark, str(DATA))
    cursor = db.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(mine.columns)
    theirs = sorted(str(r) for r in cursor.fetchall())
    assert sorted(str(tuple(r[c] for c in names)) for r in mine.collect()) == theirs
