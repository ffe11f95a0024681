"""Every query that has SQL gives the rows DuckDB gives."""

import pandas as pd
import pytest
from small_tables import DATA

from gaugework.plans import catalogue


def rows(df: pd.DataFrame) -> list:
    cell = lambda x: (bool(pd.isna(x)), 0 if pd.isna(x) else x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (p, u), (q, v) in zip(x, y, strict=True):
            assert p == q and (u == pytest.approx(v, abs=2e-6) if isinstance(u, float) else u == v), (x, y)
