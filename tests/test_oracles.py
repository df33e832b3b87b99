"""Every query with an oracle gives the same rows as its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from qaloom.plans import catalogue

SF = os.environ.get("QALOOM_TEST_SF", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=str)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    assert got == expected


def test_only_training_and_unmatched_tails_lack_an_oracle():
    without = set(catalogue.QUERIES) - set(catalogue.ORACLES)
    assert all(n.startswith(("m", "p15")) or n == "s16_chi2_p_value" or n.endswith("_interval") for n in without)
