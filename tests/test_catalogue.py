"""The contract with the driver, and some queries against their SQL."""

import glob
import math
import os

import pytest

import __spark_entry__
from vectorloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(catalogue.SQL) <= set(catalogue.QUERIES)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(catalogue.SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in cols]
    rows = sorted([tuple(plain(r[i]) for i in order) for r in want.fetchall()], key=repr)
    have = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=repr)
    assert len(have) == len(rows) and not [p for p in zip(have, rows) if p[0] != p[1]][:3]  # a few, as long lists take long to compare


def test_common_prefix_reads_all_turns(spark, tmp_path):
    rows = [(c, t, r, "x") for c in range(3) for t, r in enumerate(("system", "user", "assistant", "user", ("tool", "user", "user")[c]))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["common"] for r in __spark_entry__.queries()["common_prefix"](spark, str(tmp_path)).collect()] == [4]


def test_kquant_quantises_every_vector(spark, tmp_path):
    """Ids 0 to 9 without 5, one of them twice, one null, one vector of 32: no block is dropped."""
    ids = [0, 1, 2, 3, 4, 6, 7, 8, 8, 9, 0, None]
    rows = [(i, [((7 * k + 3 * j) % 11 - 5) / 10 for j in range(32 if i == 9 else 64)], 0) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = __spark_entry__.queries()["kquant_rtn"](spark, str(tmp_path)).collect()
    assert sorted(r["block"] for r in got if r["block"] is not None) == [0, 0, 1, 2] and sum(r["block"] is None for r in got) == 1
    assert all(r["bytes"] == 84 and 0 <= r["max_err"] < 0.4 for r in got)
