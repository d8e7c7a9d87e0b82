"""Every query that SQL can express against DuckDB on the smallest tables; every other one by shape."""

import duckdb
import pandas as pd
import pytest

from tidewright.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if x is None or x is pd.NA or x != x else f"{x:.8g}" if isinstance(x, float) else f"{float(x):.8g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(cell, row)) for row in frame.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", [k for k in QUERIES if k in ORACLES and not k.startswith(("ee_", "dk", "pg"))] + ["ee_manifest"])
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ORACLES])
def test_sequential_detectors_score_every_row(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()


def test_aliases_share_their_sql():
    assert all(k in ORACLES for k in QUERIES if k.startswith(("dk", "pg", "ee_")))
