"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from linewright.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return repr(x) if isinstance(x, float) else str(int(x)) if str(type(x)).find("bool") >= 0 else str(x)

    return list(frame.columns), sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert canonical(QUERIES[name](spark, str(DATA)).toPandas()) == canonical(db.sql(ORACLE_SQL[name]).df())
