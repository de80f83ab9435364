"""Tables that many queries read are scanned and shuffled once, and what rows share is worked out once."""

import numpy as np

from popspark.operators import diversity as D, intervals as I
from popspark.plans import bmap
from popspark.queries.views import Views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_chromosome_lengths_read_orders_once(spark):
    v = Views(spark, SF)
    assert plan(v.seqlens)[0].count("FileScan") == 1
    o = v.raw("orders").toPandas()
    want = {f"chr{k % 5 + 1}" for k in o["o_custkey"]}
    assert {(r["chrom"], r["length"]) for r in v.seqlens.collect()} == {(c, (int(o["o_orderkey"].max()) + 1) * 8) for c in want}


def test_windows_shuffle_their_sites_once(spark):
    v = Views(spark, SF)
    tiles = I.tile(v.seqlens, 8000).localCheckpoint()
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one, two = D.window_pairs(v.sites_in(8000), tiles, 8000), D.window_pairs(v.sites, tiles, 8000)
    assert key(one) == key(two)
    sums = v.sites_in(8000).groupBy("chrom", "bin").count()
    assert plan(sums)[1].count("Exchange hashpartitioning") == 1


def test_sources_of_block_sums_see_many_rows(spark):
    """Terms are made for many rows at once, so that rates and lengths that repeat cost once; sums stay as they are."""
    rows = [("a", "f", 1.0 + i % 3, 0, 0.0, 0, 0.0) for i in range(1200)]
    t = spark.createDataFrame(rows, "chrom string, feature string, length double, `__block1` long, `__away1` double, `__block-1` long, `__away-1` double")
    seen = {tuple(r["v"]) for r in bmap._block_sums(t, ["length"], np.array([0.5, 3.0]), lambda length: np.full((len(length), 2), float(len(length)))).collect()}
    assert seen == {(1200.0 * 1200, 1200.0 * 1200)}
    big = spark.createDataFrame([("a", "f", 1.0, 0, 0.0, 0, 0.0)] * 9000, t.schema)
    got = bmap._block_sums(big, ["length"], np.array([0.5, 3.0]), lambda length: np.ones(2) * length[:, None]).collect()
    assert {s: sum(r["v"][0] for r in got if r["side"] == s) for s in (1, -1)} == {1: 9000.0, -1: 9000.0}
