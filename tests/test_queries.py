"""Every registered query equals its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscope import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows):
    def one(v):
        if isinstance(v, list):
            return tuple(one(x) for x in v)
        if isinstance(v, bool) or v is None:
            return v
        return float(v) if isinstance(v, int | float) else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, name):
    got = plans.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert values(got.select(*columns).collect()) == values(want.fetchall())
