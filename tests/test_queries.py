"""Registered queries against their SQL on the smallest data."""

from __future__ import annotations

import math

import duckdb
import pytest

from duotext.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
QUICK = [n for n in registry.ORACLES if n.split("_")[0][:3] in ("pre", "sym", "sco", "hid", "mor", "src") or n.startswith(("tab2", "tab4", "phr4", "phr10", "fix4", "fix5", "aln4"))]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf_small, duck, name):
    df = registry.QUERIES[name](spark, sf_small)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert mine == theirs


def test_entry_has_every_query():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(registry.QUERIES) <= set(queries)
