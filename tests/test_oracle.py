"""Every registered query of the domain's operators against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from flocktab.plans import registry


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
