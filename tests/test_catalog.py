"""Every query with SQL equals DuckDB on the smallest tables; the others give rows."""

import duckdb
import pandas as pd
import pytest

from provena.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda v: None if v is None or isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    if name not in catalog.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    want = pd.DataFrame(want.fetchall(), columns=want.columns)
    assert rows(got) == rows(want)
