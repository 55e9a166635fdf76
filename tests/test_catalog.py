"""Every catalogue query against its SQL, and those without SQL against plain Python."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from corpusloom.catalog import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return own


def plain(value):
    """Values that both engines give alike: floats to nine digits, times without a zone."""
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}") + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def bag(rows):
    return Counter(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    got = queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert bag(got.select(*columns).collect()) == bag(duck.sql(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_without_sql(spark, sf_dir, name):
    queries()[name](spark, sf_dir).count()
