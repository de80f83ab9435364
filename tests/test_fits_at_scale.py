"""Many starts, jackknife blocks and profiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.plans import likelihood as L


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 3e6, (2, 23, 2, 2))
    slopes = [(c, b, t, f, float(a[i, b, t, k])) for i, c in enumerate(("chr1", "chr2")) for b in range(23 - 9 * i) for t in (0, 1) for k, f in enumerate("pq")]
    windows = []
    for i, c in enumerate(("chr1", "chr2")):
        for b in range(23 - 9 * i):
            pi = 0.02 * np.exp(-1e-6 * a[i, b].sum() / 2)
            d = float(rng.poisson(1e6 * pi))
            n = 0.0 if (i, b) == (0, 5) else 1e6
            windows.append((c, b, n - d if n else 0.0, d if n else 0.0, d / n if n else None))
    # a chromosome shorter than a block is in no moving block
    slopes += [("chr3", b, t, f, 1e6) for b in (0, 1) for t in (0, 1) for f in "pq"]
    windows += [("chr3", b, 980_000.0, 20_000.0, 0.02) for b in (0, 1)]
    s = spark.createDataFrame(slopes, "chrom string, bin int, ti int, feature string, a double").cache()
    return s, spark.createDataFrame(windows, "chrom string, bin int, n_same double, n_diff double, pi double").repartition(5, "bin").cache()


def test_thousands_of_starts(spark, model):
    f = L.Fit(*model)
    few = f.run(starts=3)
    many = f.run(starts=2500, seed=8, survivors=4)
    best = min(many, key=lambda r: r["nll"])
    assert len(many) == 2500 and best["converged"] and best["nll"] == pytest.approx(few[0]["nll"], rel=1e-9)
    assert sum(not r["dropped"] for r in many) <= 4 and all(r["iterations"] <= 2 for r in many if r["dropped"] and r["nll"] > 2 * best["nll"])
    # a set's nll is that of the plain prediction
    t = f.table(spark, [best])
    f.close()
    assert L.negative_log_likelihood(L.predict(model[0], t), model[1]).first()["nll"] == pytest.approx(best["nll"], rel=1e-12)


def test_sums_do_not_depend_on_blocks(model, monkeypatch):
    f = L.Fit(*model)
    x = np.random.default_rng(1).normal(0, 1, (11, 6))
    want = f.sums(f.shape.natural(x), [None] * 11)
    monkeypatch.setattr(L, "SETS", 4)
    monkeypatch.setattr(L, "FAN", 2)
    f.tasks = max(f.tasks, 3)
    for got, w in zip(f.sums(f.shape.natural(x), [None] * 11), want):
        assert got == pytest.approx(w, rel=1e-12)
    f.close()


def members(n, k, moving):
    return {i: set(range(i, i + k)) for i in range(n - k + 1)} if moving else {i: set(range(i, min(i + k, n))) for i in range(0, n, k)}


@pytest.mark.parametrize("moving", [True, False])
def test_jackknife_equals_separate_fits(spark, model, moving):
    slopes, windows = model
    blocks, theta = L.jackknife(slopes, windows, 5, moving)
    got = {(r["chrom"], r["first"]): r for r in blocks.collect()}
    sizes = {"chr1": 23, "chr2": 14, "chr3": 2}
    each = {(c, i): m for c, n in sizes.items() for i, m in members(n, 5, moving).items()}
    assert set(got) == set(each)
    data = windows.toPandas()
    known = {(r.chrom, r.bin) for r in data.itertuples() if r.n_same + r.n_diff > 0}
    assert [r["block"] for _, r in sorted(got.items())] == list(range(len(got)))
    fits = {}
    for (c, i), m in each.items():
        kept = {(d, b) for (d, j), other in each.items() if (d, j) != (c, i) for b in other} & known
        lost = m - {b for (d, j), other in each.items() if d == c and j != i for b in other}
        r = got[c, i]
        assert (r["size"], r["lost"], r["retained"]) == (len(m), len(lost), len(kept))
        key = frozenset(kept)
        if moving or len(fits) < 3:  # separate fits of the retained windows
            if key not in fits:
                alone = L.Fit(slopes, windows.join(spark.createDataFrame(sorted(kept), "chrom string, bin int"), ["chrom", "bin"]))
                fits[key] = alone.run(starts=1, seed=4)[0]
                alone.close()
            assert r["nll"] == pytest.approx(fits[key]["nll"], rel=1e-9) and r["pi0"] == pytest.approx(fits[key]["pi0"], rel=1e-3)
    if moving:
        assert theta.select("theta_id").distinct().count() == len(fits) <= 5
    # correlation over a block's own windows
    t = theta.join(blocks.filter("chrom = 'chr2' AND first = 5").select("theta_id"), "theta_id")
    p = {(r["chrom"], r["bin"]): r["pi"] for r in L.predict(slopes, t).collect()}
    own = data[(data.chrom == "chr2") & data.bin.isin(range(5, 10))]
    assert got["chr2", 5]["r"] == pytest.approx(np.corrcoef([p[r.chrom, r.bin] for r in own.itertuples()], own.pi)[0, 1], rel=1e-6)


def test_one_block(model):
    all_, _ = L.jackknife(*model, 5)
    n = all_.count()
    one, theta = L.jackknife(*model, 5, number=0)
    assert [tuple(r) for r in one.select("chrom", "first", "lost").collect()] == [("chr1", 0, 1)] and theta.select("theta_id").distinct().count() == 2
    some, _ = L.jackknife(*model, 5, fraction=0.5)
    assert [r["block"] for r in some.collect()] == [int(0.5 * n)]


def test_profile_of_weights(spark, model):
    slopes, windows = model
    theta = spark.createDataFrame([(0, 0.02, 1e-6, t, f, w) for f in "pq" for t, w in ((0, 0.25), (1, 0.75))], "theta_id int, pi0 double, mu double, ti int, feature string, weight double")
    got = {(r["mu"], r["w_0_p"]): r["nll"] for r in L.profile(slopes, windows, theta, weights={(0, "p"): [0.1, 0.25, 0.9]}, rescale=True, mu=[1e-6, 2e-6]).collect()}
    assert len(got) == 6
    assert got[1e-6, 0.25] == pytest.approx(L.negative_log_likelihood(L.predict(slopes, theta), windows).first()["nll"])
    moved = theta.withColumn("weight", F.when(F.col("feature") == "p", F.when(F.col("ti") == 0, 0.9).otherwise(0.1)).otherwise(F.col("weight")))
    assert got[1e-6, 0.9] == pytest.approx(L.negative_log_likelihood(L.predict(slopes, moved), windows).first()["nll"])
    plain = L.profile(slopes, windows, theta, weights={(0, "p"): [0.9]}).first()
    kept = theta.withColumn("weight", F.when((F.col("feature") == "p") & (F.col("ti") == 0), 0.9).otherwise(F.col("weight")))
    assert plain["nll"] == pytest.approx(L.negative_log_likelihood(L.predict(slopes, kept), windows).first()["nll"])


def test_out_of_sample_average_and_space(spark, model):
    by = spark.createDataFrame([("a", 0.5, 10), ("b", 1.0, 30), ("c", None, 5)], "left_out string, r double, n long")
    one = L.average_r(by).first()
    assert one["r"] == pytest.approx(0.875) and one["n"] == 40
    slopes, windows = model
    theta = spark.createDataFrame([(0, 0.02, 1e-6, t, f, 0.5) for f in "pq" for t in (0, 1)], "theta_id int, pi0 double, mu double, ti int, feature string, weight double")
    w = windows.withColumns({"start": F.col("bin") * 10, "end": F.col("bin") * 10 + 10})
    got = L.residuals_in_space(L.predict(slopes, theta), w).collect()
    assert len(got) == w.count() and [r["midpoint"] for r in got if r["z"] is None and r["chrom"] != "chr3"] == [55.0]  # the third does not vary
    z = [r["z"] for r in got if r["chrom"] == "chr1" and r["z"] is not None]
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1)
