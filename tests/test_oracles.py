"""Every registered query of the library runs on the smallest data and agrees with its SQL in DuckDB."""

import math

import duckdb
import pytest

from tallyframe import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def key(row):
    return [(x is None, round(x, 3) if isinstance(x, float) else str(x)) for x in row]


def agree(a, b):
    """Rounded values are compared as they are: the queries round on both sides."""
    return a == b


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=key)
    if name not in plans.ORACLES:
        assert got
        return
    res = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in order] for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(agree, g, w))]
    assert not bad, bad[:3]
