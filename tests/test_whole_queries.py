"""Queries read whole inputs: no prefixes, no fits cut short."""

import numpy as np
import pytest

from popspark.catalog import QUERIES
from popspark.plans import likelihood as L

SF = "/root/testdata/sf0.001"


def test_segments_reach_the_end_of_every_text(spark):
    got = QUERIES["agg33_segment_gc_whole"](spark, SF).groupBy("doc_id").agg({"start": "max", "gc": "count"}).toPandas().set_index("doc_id")["max(start)"].to_dict()
    size = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "length(text)").collect() if r[1]}
    assert max(size.values()) > 140 and got == {k: (n - 1) // 40 * 40 for k, n in size.items()}


def test_fits_converge(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 3e6, (40, 2, 2))
    slopes = spark.createDataFrame([("a", b, t, f, float(a[b, t, k])) for b in range(40) for t in (0, 1) for k, f in enumerate("pq")], "chrom string, bin int, ti int, feature string, a double")
    pi = 0.02 * np.exp(-1e-6 * a @ [0.5, 0.5]).mean(axis=1)
    rows = [("a", b, b // 4, float(1e6 * (1 - pi[b])), float(rng.poisson(1e6 * pi[b]))) for b in range(40)]
    windows = spark.createDataFrame(rows, "chrom string, bin int, block int, n_same double, n_diff double")
    f = L.Fit(slopes, windows, "block")
    full = [r for seed in (1, 2) for r in f.run(starts=2, seed=seed)]
    assert all(r["converged"] for r in full) and all(r["nll"] == pytest.approx(full[0]["nll"], rel=1e-9) for r in full)
    assert all(r["pi0"] == pytest.approx(full[0]["pi0"], rel=1e-3) and r["mu"] == pytest.approx(full[0]["mu"], rel=1e-3) for r in full)
    left = {r["left_out"]: r for r in f.run(starts=1, leave_out=True)}
    short = f.run(starts=1, iterations=1)
    assert not short[0]["converged"] and short[0]["iterations"] == 2
    f.close()
    assert len(left) == 10 and all(r["converged"] for r in left.values())
    for block in (0, 7):
        alone = L.Fit(slopes, windows.filter(f"block <> {block}"))
        r = alone.run(starts=1, seed=9)[0]
        alone.close()
        assert all(left[str(block)][k] == pytest.approx(r[k], rel=1e-3) for k in ("pi0", "mu")) and left[str(block)]["nll"] == pytest.approx(r["nll"], rel=1e-9)


def test_selection_formulas(spark):
    """Against the published formulas written out with floats, and at their limits."""
    import math

    from pyspark.sql import functions as F

    from popspark.functions import scalars as S

    row = spark.range(1).select(
        S.p_fix(1000, 0.01).alias("p"), S.p_fix(1000, F.lit(0.0)).alias("p_neutral"), S.p_fix(100, -0.02, 0.1).alias("p_worse"),
        S.q_fixed(7, 2.0, 0.5, 0.1).alias("q"), S.q_fixed(7, 1.0, 1.0, 0.1).alias("q_none"), S.q_asymptotic(2.0, 0.5, 0.1).alias("q_all"),
        S.b_variance_limit(0.8, 3.0).alias("v"), S.b_variance_limit(0.8, 3.0, 500, 10).alias("v_finite"), S.b_variance_limit(0.8, 1.0, 10**12, 10**6).alias("v_large"),
    ).first()
    assert row["p"] == pytest.approx((1 - math.exp(-0.01)) / (1 - math.exp(-20)))
    assert row["p_neutral"] == 0.0005 and row["p_worse"] == pytest.approx((1 - math.exp(0.4)) / (1 - math.exp(4)))
    assert row["q"] == pytest.approx(sum(0.675**k for k in range(8))) and row["q_none"] == 1 and row["q_all"] == pytest.approx(1 / 0.325)
    assert row["v"] == pytest.approx(2 / 9 * 0.64 / 3) and row["v_large"] == pytest.approx(2 / 9 * 0.64, rel=1e-5)
    assert row["v_finite"] == pytest.approx((11 / 27 * 0.8 / 2000 + 226 / 810 * 0.64) / 3)


def test_uncovered_parts_and_strict_rescaling(spark):
    from pyspark.sql import functions as F

    from popspark.operators import intervals as I
    from popspark.plans import bmap as B

    features = spark.createDataFrame([("c", 0, 10), ("c", 8, 30), ("d", 5, 6)], "chrom string, start long, end long")
    recmap = spark.createDataFrame([("c", 4, 20, 1e-8), ("c", 20, 25, None)], "chrom string, start long, end long, rate double")
    assert sorted(map(tuple, I.uncovered(features, recmap).select("chrom", "start", "end").collect())) == [("c", 0, 4), ("c", 20, 30), ("d", 5, 6)]
    bmap = spark.createDataFrame([("c", x, 0, 0, "f", v) for x, v in ((0, -0.5), (40, 0.5))], "chrom string, pos long, wi int, ti int, feature string, log_b double")
    high, low = features.filter("end = 30").withColumn("start", F.lit(28).cast("long")), features.filter("end = 10")
    assert B.rescaled(high, bmap, 0, 0, strict=False).first()["n_scale"] == 1 and 0 < B.rescaled(low, bmap, 0, 0, strict=True).first()["n_scale"] < 1
    with pytest.raises(Exception, match="outside"):
        B.rescaled(high, bmap, 0, 0, strict=True).collect()

