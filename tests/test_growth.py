"""Work that must grow with the input only: frames to the end of a window, gaps as long as a chromosome, sums over all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import diversity, genmap, intervals as I, resample, scans
from popspark.plans import bmap


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_runs_to_the_end(spark):
    """Spark sums a frame that ends at UNBOUNDED FOLLOWING anew for every row."""
    points = spark.range(200).select(F.lit("a").alias("chrom"), (F.col("id") * 10).alias("pos"), ((F.col("id") * 37 % 50) + F.col("id")).cast("double").alias("cum"))
    blocks = scans.carried(points.withColumn("__block", F.floor(F.col("pos") / 70)), ["chrom"], after=(F.min("cum"), F.min, 1))
    for frame in (genmap.clean(points), blocks):
        assert not re.search(r"1, unboundedfollowing", plan(frame).lower())
    cum = [float(i * 37 % 50 + i) for i in range(200)]
    want = [i * 10 for i in range(200) if cum[i] >= max(cum[:i], default=cum[i]) and cum[i] <= min(cum[i + 1 :], default=cum[i])]
    assert sorted(r["pos"] for r in genmap.clean(points).collect()) == want
    for r in blocks.collect():
        later = [c for i, c in enumerate(cum) if i * 10 // 70 > r["pos"] // 70]
        assert r["after"] == min(later, default=None)


def test_gaps_between_genes_cost_nothing(spark):
    """A gene far down the chromosome is looked at where it is: rows between operators stay near the genes' number."""
    genes = spark.range(50).select(F.lit("a").alias("chrom"), F.col("id").alias("gene"), (F.col("id") * 1_000_000_000_000 + 5).alias("start"), (F.col("id") * 1_000_000_000_000 + 105).alias("end"))
    exons = genes.select("chrom", "gene", (F.col("start") + 20).alias("start"), (F.col("start") + 30).alias("end"))
    got = sorted((r["gene"], r["start"], r["end"]) for r in I.introns(genes, exons, by="gene").collect())
    assert got == sorted((g, g * 10**12 + a, g * 10**12 + b) for g in range(50) for a, b in ((5, 25), (35, 105)))


def test_subtract_within_keeps_repeats_and_other_columns(spark):
    a = spark.createDataFrame([("a", 0, 10, "x"), ("a", 0, 10, "x"), ("a", 0, 10, None), ("a", -5, 4, "y"), ("b", 3, 6, "z"), (None, 1, 2, "n")], "chrom string, start long, end long, tag string")
    b = spark.createDataFrame([("a", 2, 3), ("a", 3, 5), ("a", 4, 6), ("c", 0, 9)], "chrom string, start long, end long")
    got = sorted((r["chrom"], r["tag"] or "", r["start"], r["end"]) for r in I.subtract_within(a, b, ["chrom"]).collect())
    assert got == sorted([*[("a", t, s, e) for t in ("x", "x", "") for s, e in ((0, 2), (6, 10))], ("a", "y", 0, 2), ("b", "z", 3, 6)])


def test_sums_by_blocks_are_those_over_all_pairs(spark):
    """Dense, sparse and flat maps: the same sums to the rounding of doubles, from a number of pairs that follows the input."""
    seg, pts = [], []
    for c, n, morgans in (("a", 400, 1e-6), ("b", 13, 1e-4), ("flat", 20, 0.0)):
        pts += [(c, p, p * morgans) for p in range(0, n * 100, 100)]
        seg += [(c, s, s + 1 + s % 300, "fg"[s % 2], (0.0, 1e-6, 1e-5)[s % 3], s * morgans, (s + 1 + s % 300) * morgans) for s in range(7, n * 120, 121)]
    p = spark.createDataFrame(pts, "chrom string, pos long, map_pos double")
    s = spark.createDataFrame(seg, "chrom string, start long, end long, feature string, rate double, map_start double, map_end double")
    cells = lambda m: {(r["chrom"], r["pos"], r["feature"], r["wi"], r["ti"]): r["log_b"] for r in m.collect()}
    got, want = cells(bmap.classic_map(p, s, [1e-6], [0.001, 0.01])), cells(bmap.classic_map(p, s, [1e-6], [0.001, 0.01], bmap.TILE))
    assert got == pytest.approx(want, rel=1e-13)
    assert bmap._blocked(p, s).filter("chrom = 'a'").count() < 0.2 * bmap._pairs(p, s).filter("chrom = 'a'").count()
    far = {(r["chrom"], r["pos"]): (r["n"], r["distance"]) for r in bmap.distances(p, s).collect()}
    every = bmap._pairs(p, s).groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.sum("rf").alias("distance")).collect()
    assert len(far) == len(every) and all(far[r["chrom"], r["pos"]] == pytest.approx((r["n"], r["distance"]), rel=1e-12) for r in every)


def test_decays_give_the_kernel():
    x = np.geomspace(1e-3, 1e3, 50)
    s, c = bmap.decays(1e-3)
    for q in (1e-9, 1e-3, 1.0, 50.0):
        assert (np.exp(-x[:, None] * s) * c * -np.expm1(-q * s) / (q * s)).sum(axis=1) * x * (x + q) == pytest.approx(np.ones(50), rel=2e-14)


def test_ratchet_sums_by_blocks_are_those_over_all_pairs(spark):
    """On a map of more than two Morgans, so that some segments are past the distance at which the effect stays the same."""
    pts = [("a", p, p * 1e-5) for p in range(0, 250_000, 5_000)] + [("b", p, p * 1e-4) for p in range(0, 3000, 100)]
    seg = [("a", s, s + 1 + s % 16, "fg"[s % 2], (1e-8, 1e-6)[s % 3 % 2], s * 1e-5, (s + 1 + s % 16) * 1e-5) for s in range(7, 250_000, 401)]
    seg += [("b", s, s + 16, "f", 1e-6, s * 1e-4, (s + 16) * 1e-4) for s in range(7, 900, 60)]
    p = spark.createDataFrame(pts, "chrom string, pos long, map_pos double")
    s = spark.createDataFrame(seg, "chrom string, start long, end long, feature string, rate double, map_start double, map_end double")
    cells = lambda m: {(r["chrom"], r["pos"], r["feature"], r["wi"], r["ti"]): r["log_b"] for r in m.collect()}
    got, want = (cells(bmap.ratchet_map(p, s, [1e-7, 1e-6], [1e-4, 1e-3], 1000.0, tile)) for tile in (None, bmap.TILE))
    assert got == pytest.approx(want, rel=1e-12)


def test_masks_shuffle_sites_once(spark):
    sites = spark.range(1000).select(F.lit("a").alias("chrom"), (F.col("id") * 7).alias("pos"))
    mask = lambda k: spark.range(100).select(F.lit("a").alias("chrom"), (F.col("id") * 70 + k).alias("start"), (F.col("id") * 70 + k + 30).alias("end"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        masked = diversity.mask_sites(sites, mask(0), mask(20))
        assert masked._jdf.queryExecution().sparkPlan().toString().count("LeftSemi") == 2
        assert masked._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].count("Exchange hashpartitioning") == 3
        assert sorted(r["pos"] for r in masked.collect()) == [i * 7 for i in range(1000) if 20 <= i * 7 % 70 < 30]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_overlay_is_one_scan(spark):
    """Equal to the label of least rank at every base, from a plan without a join of pieces with intervals, and across blocks of a scan."""
    rng = np.random.default_rng(5)
    rows = [(f"c{k % 2}", int(s), int(s + n), "xyz?"[j]) for k, (s, n, j) in enumerate(zip(rng.integers(-20, 400, 120), rng.integers(-1, 12, 120), rng.integers(0, 4, 120)))]
    tracks = spark.createDataFrame([*rows, (None, 1, 5, "x"), ("c0", None, 5, "x"), ("c1", 7, 9, None)], "chrom string, start long, end long, feature string")
    want = {}
    for c, s, e, f in rows:
        for p in range(s, e):
            if f != "?":
                want[c, p] = min(want.get((c, p), "z"), f)
    old = scans.BLOCK, scans.SMALL
    for scans.BLOCK, scans.SMALL in (old, (16, -1)):
        try:
            got = I.overlay(tracks, ["x", "y", "z"])
            assert "__bucket" not in plan(got)
            pieces = sorted((r["chrom"], r["start"], r["end"], r["feature"]) for r in got.collect())
        finally:
            scans.BLOCK, scans.SMALL = old
        assert {(c, p): f for c, s, e, f in pieces for p in range(s, e)} == want and sum(e - s for _, s, e, _ in pieces) == len(want)
        assert not any(a[0] == b[0] and a[2] == b[1] and a[3] == b[3] for a, b in zip(pieces, pieces[1:]))


def test_block_sums_take_a_segment_once(spark):
    """One row of a segment gives the sums of both its ends, also where it begins and ends in different blocks, and across batches."""
    s = np.array([0.5, 3.0])
    rows = [("a", "fg"[i % 2], 1.0 + i, i // 400, 0.001 * (i % 7), (i + 3) // 400, 0.002 * (i % 5)) for i in range(1200)]
    t = spark.createDataFrame(rows, "chrom string, feature string, length double, `__block1` long, `__away1` double, `__block-1` long, `__away-1` double")
    sums = bmap._block_sums(t, ["length"], s, lambda length: np.ones(2) * length[:, None])
    got, want = {}, {}
    for r in sums.collect():
        got[r["feature"], r["side"], r["__block"]] = got.get((r["feature"], r["side"], r["__block"]), 0) + np.array(r["v"])
    for _, f, n, b1, a1, b2, a2 in rows:
        for side, b, a in ((1, b1, a1), (-1, b2, a2)):
            want[f, side, b] = want.get((f, side, b), 0) + n * np.exp(-a * s)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-13) for k in want)


@pytest.mark.parametrize("name", ["mod12_residuals", "mod20_likelihood_ratio", "mod13_average_r"])
def test_windows_are_summed_once(spark, name):
    """What reads its windows more than once keeps them, so that sites are not summed up again."""
    from popspark.catalog import QUERIES

    assert not any("lineitem" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles())


def rows_sent_to_all(frame):
    """The rows of the largest broadcast in the plan that a collected frame ended with."""
    store, most = frame.sparkSession._jsparkSession.sharedState().statusStore(), 0
    last = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())))
    nodes, values = store.planGraph(last).allNodes(), store.executionMetrics(last)
    for n in (nodes.apply(i) for i in range(nodes.size())):
        for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
            if n.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_drawn_windows_do_not_pass_through_the_driver(spark):
    """Spark took the draws of a bootstrap for a few bytes and broadcast them all."""
    sizes = {"a": 3000, "b": 2000, "short": 2}
    w = spark.createDataFrame([(c, 2 * i, float(i)) for c, n in sizes.items() for i in range(n)], "chrom string, bin int, n_same double").repartition(3)
    drawn = resample.block_bootstrap(w, 4, 20, seed=3)
    rows = drawn.collect()
    assert 0 < rows_sent_to_all(drawn) <= 5002 and len(rows) == 20 * 5000
    got = {}
    for r in rows:
        got.setdefault((r["replicate"], r["draw"], r["chrom"]), []).append(r["bin"])
    assert {k[:2] for k in got} == {(i, j) for i in range(20) for j in range(1, 1251)} and len(got) == 20 * 1250
    assert all(sorted(v) == [min(v) + 2 * i for i in range(4)] and max(v) < 2 * sizes[c] for (_, _, c), v in got.items())
    assert 0.57 < sum(c == "a" for _, _, c in got) / len(got) < 0.63
