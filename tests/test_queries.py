"""Every query with an oracle gives the oracle's rows on the smallest test tables."""

import math
import os

import pytest

from sluice.plans import load

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(names, found):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cursor.fetchall())
