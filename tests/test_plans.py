"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lexarium.plans import registry

SF = "/root/testdata/sf0.001"


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())
