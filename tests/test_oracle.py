"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from weftline.plans import registry

Q, O = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    try:
        x = float(v)
        return None if math.isnan(x) else round(x, 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(O))
def test_same_rows(spark, sf, con, name):
    got = Q[name](spark, sf)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    res = con.execute(O[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert a == b


def test_all_queries_are_known():
    assert set(O) <= set(Q)
    assert len(Q) > 100
