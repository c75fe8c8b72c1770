"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from reverie import catalog
from tests.conftest import SF

SQL = catalog.oracle_sql()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    try:
        number = float(value)
        return repr(round(number, 9) + 0.0)
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_rows(spark, duck, name):
    found = catalog.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(found.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
