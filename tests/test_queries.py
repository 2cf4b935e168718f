"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from ringlight.plans.oracle import ORACLE_SQL
from ringlight.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark".split()


@pytest.fixture(scope="module")
def duck(smallest):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    return c


def rows(df):
    def plain(x):
        return "" if x is None or x != x else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_matches_sql(spark, duck, smallest, name):
    mine, theirs = QUERIES[name](spark, smallest).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
