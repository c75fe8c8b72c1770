"""Corpus queries with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from reverie.llm import registry
from tests.conftest import SF
from tests.test_oracle import rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())
