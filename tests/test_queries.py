"""Every query against its SQL on the small tables."""

import duckdb
import pytest

from isochrona.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df, sql = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert rows(df.select(*columns).collect()) == rows(sql.select(*columns).fetchall())
