"""The registered queries against their SQL, on the smallest tables where the driver's data is there."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
SOME = ["cosine_topk", "l2_no_take_bare", "l2_no_take_store", "meta_equal_ts", "l2_topk_arrow", "batch_no_take", "row_mask_topk", "meta_cnf", "meta_tautology_distributed", "meta_nan_neq", "zone_map", "pruned_chunks", "query_stats", "parse_datetimes", "standing_query"]


def plain(row):
    return tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    names = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(plain, ours.select(*names).collect())) == sorted(map(plain, theirs.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
