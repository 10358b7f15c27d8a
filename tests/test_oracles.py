"""Every query of the catalogue against its SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarrylens.plans import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)) or isinstance(v, (float, np.floating)) and float(v).is_integer():
        return int(v)
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert rows(found) == rows(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(found)
