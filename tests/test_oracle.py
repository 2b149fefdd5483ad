"""Every registered query with SQL gives DuckDB's rows over the same tables; the others run."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from tidegauge import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(value):
    """Values of both engines in one form."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in (value.asDict().values() if hasattr(value, "asDict") else value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 9) + 0.0
    return value


def in_order(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    names = found.columns
    assert len({n.lower() for n in names}) == len(names)
    rows = in_order(names, [tuple(r) for r in found.collect()])
    if name not in catalog.ORACLE_SQL:
        return
    wanted = duck.execute(catalog.ORACLE_SQL[name])
    wanted_names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(wanted_names)
    assert rows == in_order(wanted_names, wanted.fetchall())
