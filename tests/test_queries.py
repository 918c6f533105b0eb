"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from streamstage.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v if isinstance(v, (str, bool)) else round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__int__") else v

    return sorted(str([one(v) for v in row]) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, told = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(told.columns)
    assert plain(got) == plain(told)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).toPandas()
    assert (len(rows), int(rows.anomaly.sum()), int((rows.severity == "high").sum()), int((rows.value == 150).sum())) == (1000, 236, 193, 40)
