"""Smaller parts of operators: both ways of a conversion, trimming, bands, checks."""

import pytest
from pyspark.sql import functions as F

from popspark.operators import resample as B
from popspark.operators import stats as T
from popspark.plans import bmap as M
from popspark.plans import likelihood as L
from popspark.sources import tables


def test_ranks(spark):
    x = [(i * 37 % 101) // 3 for i in range(300)]
    rows = spark.createDataFrame([(v,) for v in x], "x int")
    want = sorted((v, sum(u < v for u in x) + (x.count(v) + 1) / 2) for v in x)
    for blocks in (2, 16, 1000):
        assert sorted((r.x, r.r) for r in T.ranked(rows, "x", "r", blocks).collect()) == want
    assert T.ranked(rows.limit(0), "x", "r").count() == 0


def test_forms_tails_and_bins(spark):
    long = spark.createDataFrame([(1, "a", 0.5, 0.1), (1, "b", 0.25, 0.2), (2, "a", 1.0, None)], "id int, feature string, value double, se double")
    wide = {r.id: r for r in T.wide_form(long, ["id"], ["a", "b"], error="se").collect()}
    assert (wide[1].a, wide[1].b_se, wide[2].a, wide[2].b) == (0.5, 0.2, 1.0, None)
    assert sorted(r.id for r in T.cut_tails(spark.range(101), "id", 0.05).collect()) == list(range(5, 96))
    rows = spark.range(400).select((F.col("id") / 400).alias("x"), (F.col("id") >= 200).cast("double").alias("y"))
    assert T.best_bins(T.cv_bins(rows, "x", "y", [1, 2, 3])).first()["nbins"] == 2


def test_errors_and_bands(spark):
    rows = spark.createDataFrame([("p", float(v)) for v in (1, 2, 3, 4, 1000)], "name string, v double")
    e = B.jackknife_error(rows, ["name"], "v", iqr=5).first()
    assert e["n"] == 4 and e["mean"] == 2.5 and e["stderr"] == pytest.approx((3 * 1.25) ** 0.5)
    s = B.sigma_interval(spark.createDataFrame([(1.0, 0.25)], "m double, stderr double"), "m", factor=2).first()
    assert (s["lower"], s["upper"]) == (0.5, 1.5)
    line = spark.range(200).select(F.col("id").cast("double").alias("x"), (3 + 2 * F.col("id") + F.pmod(F.hash("id"), F.lit(7)) - 3).alias("y"))
    got = B.regression_band(line, spark.createDataFrame([(0.0,), (100.0,)], "at double"), "x", "y", 50).collect()
    assert len(got) == 2 and all(r["lower"] <= r["median"] <= r["upper"] and abs(r["median"] - 3 - 2 * r["at"]) < 1.5 for r in got)


def test_labels_and_profile(spark):
    t = [1e-3, 1e-2]
    theta = spark.createDataFrame([(7, 0.02, 1e-8, i, f, w) for f, ws in (("p,q", (0.25, 0.75)), ("r", (1.0, 0.0))) for i, w in enumerate(ws)], "theta_id int, pi0 double, mu double, ti int, feature string, weight double")
    back = L.labelled_parameters(L.parameter_labels(theta, t), t)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, theta.collect()))
    slopes = spark.createDataFrame([("c", b, i, f, 1e6 * (b + i)) for b in (0, 1) for i in (0, 1) for f in ("p,q", "r")], "chrom string, bin int, ti int, feature string, a double")
    windows = spark.createDataFrame([("c", 0, 980.0, 20.0), ("c", 1, 985.0, 15.0)], "chrom string, bin int, n_same double, n_diff double")
    got = {(r["pi0"], r["mu"]): r["nll"] for r in L.profile(slopes, windows, theta, pi0=[0.02, 0.03], mu=[1e-8, 2e-8]).collect()}
    one = L.negative_log_likelihood(L.predict(slopes, theta), windows).first()["nll"]
    assert len(got) == 4 and got[0.02, 1e-8] == pytest.approx(one)


def test_residual_check(spark):
    binned = spark.createDataFrame([("c", 0, 0, "f", i, y) for i, y in enumerate((0.0, -5.0, 0.0))], "chrom string, bin int, ti int, feature string, wi int, log_b double")
    assert M.collapse_w(binned, [1.0, 2.0, 3.0], 10.0).count() == 1
    with pytest.raises(Exception, match="residual of the mutation axis"):
        M.collapse_w(binned, [1.0, 2.0, 3.0], 5e-3).collect()


def test_cumulative_bed_and_gtf(spark, tmp_path):
    (tmp_path / "m.bed").write_text("c\t0\t10\t0.0\nc\t10\t30\t0.5\n")
    assert sorted(map(tuple, tables.cumulative_bed(spark, str(tmp_path / "m.bed")).collect())) == [("c", 0, 0.0), ("c", 10, 0.5), ("c", 30, 0.5)]
    (tmp_path / "g.gtf").write_text('c\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; tag "a"; tag "b";\n')
    r = tables.gff(spark, str(tmp_path / "g.gtf")).first()
    assert r["start"] == 10 and r["attributes"] == {"gene_id": "g1", "transcript_id": "t1", "tag": "a"}
