"""Literal cases and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.functions import scalars as S
from popspark.operators import diversity as D, genmap, intervals as I, rangejoin as R, stats as T
from popspark.plans import bmap as M, likelihood as L


def ranges(spark, rows, extra="feature string"):
    return spark.createDataFrame(rows, f"chrom string, start long, end long, {extra}")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lengths(spark, **n):
    return spark.createDataFrame(list(n.items()), "chrom string, length long")


def test_priority_overlay(spark):
    t = ranges(spark, [("a", 1, 3, "introns"), ("a", 5, 8, "introns"), ("a", 2, 4, "cds"), ("a", 8, 9, "cds")])
    got = rows(I.overlay(t, ["cds", "introns"]), "start", "end", "feature")
    assert got == [(1, 2, "introns"), (2, 4, "cds"), (5, 8, "introns"), (8, 9, "cds")]


@pytest.mark.parametrize(("n", "edges"), [(13, [(0, 4), (4, 8), (8, 12), (12, 13)]), (12, [(0, 4), (4, 8), (8, 12)])])
def test_tiling(spark, n, edges):
    assert rows(I.tile(lengths(spark, a=n), 4), "start", "end") == edges


def test_segment_values(spark):
    r = spark.range(1).select(S.b_segment(1e-8, 0.1, 1000, 1e-8, 1e-9).alias("a"), S.b_within(1e-8, 0.1, 1000, 1e-8).alias("b")).first()
    assert r["a"] == pytest.approx(0.99990001, abs=1e-8) and r["b"] == pytest.approx(0.99990001, abs=1e-8)


def test_map_intervals(spark):
    p = spark.createDataFrame([("a", 5, 1.1), ("a", 6, 2.3), ("a", 10, 3.2)], "chrom string, pos long, rate double")
    got = rows(genmap.recmap(p, lengths(spark, a=12)), "start", "end", F.round(F.col("rate") * 1e8, 6).alias("r"))
    assert got == [(0, 5, 0.0), (5, 6, 1.1), (6, 10, 2.3), (10, 12, 3.2)]


def test_clean_map(spark):
    v = [0, 1, 1, 3, 4, 1, 5, 4, 7]
    p = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "chrom string, pos long, cum double")
    assert rows(genmap.clean(p), "pos", "cum") == [(0, 0.0), (1, 1.0), (2, 1.0), (8, 7.0)]


def random_ranges(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 20000, n)
    e = s + rng.integers(0, 700, n)
    return ranges(spark, [(f"c{i % 2}", int(a), int(min(b, 20000)), "x") for i, (a, b) in enumerate(zip(s, e))])


def bases(df):
    return df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]


def test_interval_laws(spark):
    a, b = random_ranges(spark).cache(), random_ranges(spark, seed=4).cache()
    n = lengths(spark, c0=20000, c1=20000)
    m = I.merge(a)
    assert rows(I.merge(m), "chrom", "start", "end") == rows(m, "chrom", "start", "end")
    assert rows(I.complement(I.complement(a, n), n), "chrom", "start", "end") == rows(m, "chrom", "start", "end")
    assert bases(I.intersect(m, I.merge(b))) + bases(I.subtract(m, b, n)) == bases(m)
    assert not any(r["overlapping"] for r in I.contains_overlaps(m).collect())


def test_bucket_width_does_not_matter(spark):
    a, b = random_ranges(spark), random_ranges(spark, seed=5)
    counts = {R.overlaps(a, b, k).count() for k in (16, 512, 4096, 100000)}
    assert len(counts) == 1
    p = a.select("chrom", F.col("start").alias("pos"))
    assert len({R.within(p, b, "left_semi", k).count() for k in (16, 4096)}) == 1


def test_cumulative_and_marginal_are_inverse(spark):
    p = spark.createDataFrame([("a", i * 100, float(i % 7)) for i in range(50)], "chrom string, pos long, rate double")
    m = genmap.recmap(p, lengths(spark, a=5000))
    back = genmap.marginal(m.select("chrom", F.col("end").alias("pos"), (F.col("cum_end") * 100).alias("cum")))
    got = {r["pos"]: r["rate"] for r in back.collect()}
    want = {r["start"]: r["rate"] * 1e8 for r in m.collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want if k in got and k)


def test_windows_sum_to_chromosomes(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([("a", int(i * 7), int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 9, (200, 2)))], "chrom string, pos long, n_ref int, n_alt int")
    w = D.window_pairs(s, I.tile(lengths(spark, a=1400), 100), 100).agg(F.sum("n_same"), F.sum("n_diff")).first()
    c = D.pair_counts(s).agg(F.sum("n_same"), F.sum("n_diff")).first()
    assert tuple(w) == tuple(c)


def test_windows_without_sites_stay(spark):
    s = spark.createDataFrame([("a", 5, 2, 2)], "chrom string, pos long, n_ref int, n_alt int")
    got = rows(D.window_pairs(s, I.tile(lengths(spark, a=30), 10), 10), "bin", "n_sites", "pi")
    assert got[0][:2] == (0, 1) and got[1] == (1, 0, None) and got[2] == (2, 0, None)


def test_scalars(spark):
    r = spark.range(1).select(S.log1mexp(-1e-9).alias("a"), S.log1mexp(-50).alias("b"), S.signif(0.0).alias("z"), S.ratchet_time(1.0, 1e6, 1).alias("o")).first()
    assert r["a"] == pytest.approx(math.log(1e-9), rel=1e-6) and r["b"] == pytest.approx(-math.exp(-50)) and r["z"] == 0 and r["o"] is None


def test_chromosome_order(spark):
    d = spark.createDataFrame([(c,) for c in ("chr10", "chrX", "chr2", "chrM", "chr1", "chrY")], "chrom string")
    assert [r[0] for r in d.orderBy(genmap.chrom_key(F.col("chrom"))).collect()] == ["chr1", "chr2", "chr10", "chrX", "chrY", "chrM"]


def test_ratchet_solution():
    t, v, vm = M.solve_ratchet(1e-8, np.array([1e-5, 1e-4, 5e-2]), 1e4, 1e-8, 1e4)
    u = 2 * 1e4 * 1e-8
    for i, sh in enumerate((1e-5, 1e-4)):
        z = 1 - vm[i] / v[i]
        ne = 1e4 * math.exp(-v[i] / 2 * -2 / ((z - 1) * (2 + (1e-4 - 2) * z)))
        assert math.expm1(4 * sh * ne) / (2 * u * sh * ne) == pytest.approx(t[i], rel=1e-6)
    assert np.isinf(t[2]) and v[2] == pytest.approx(u * 5e-2)


def test_gradient_matches_differences(spark):
    rng = np.random.default_rng(2)
    sl = [("a", b, t, f, float(x)) for b in range(6) for t in (0, 1) for f in ("p", "q") for x in [rng.uniform(1e4, 1e5)]]
    slopes = spark.createDataFrame(sl, "chrom string, bin int, ti int, feature string, a double")
    w = spark.createDataFrame([("a", b, float(900 + b), float(100 - 5 * b)) for b in range(6)], "chrom string, bin int, n_same double, n_diff double")
    f = L.Fit(slopes, w)
    x = rng.normal(0, 1, (1, 6))
    nll, g = f.evaluate(x, [None])
    for k in range(6):
        e = np.zeros_like(x)
        e[0, k] = 1e-5
        d = (f.evaluate(x + e, [None])[0] - f.evaluate(x - e, [None])[0]) / 2e-5
        assert g[0, k] == pytest.approx(d[0], rel=1e-3, abs=1e-4)
    best = min(r["nll"] for r in f.run(starts=2, iterations=10))
    assert best <= nll[0]
    f.close()


def test_savitzky_golay_keeps_polynomials(spark):
    d = spark.createDataFrame([("a", i, 2.0 + 3 * i) for i in range(12)], "chrom string, bin int, y double")
    got = T.stencil(d, "y", T.savitzky_golay_weights(5, 2)).orderBy("bin").collect()
    assert all(r["smooth"] == pytest.approx(r["y"]) for r in got)


def test_empty_tables(spark):
    e = ranges(spark, [])
    n = lengths(spark, a=10)
    assert I.merge(e).count() == 0 and rows(I.complement(e, n), "start", "end") == [(0, 10)]
    assert I.overlay(e, ["x"]).count() == 0 and R.overlaps(e, e).count() == 0


def test_grids_and_labels(spark):
    assert M.parse_grid("-3:-1:3") == pytest.approx([1e-3, 1e-2, 1e-1]) and M.parse_grid("1,2") == [1.0, 2.0]
    assert M.parameter_grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    t = spark.createDataFrame([(0, 0.1, 1e-8, 0, "cds", 0.4), (0, 0.1, 1e-8, 1, "cds", 0.6)], "theta_id int, pi0 double, mu double, ti int, feature string, weight double")
    got = {r["name"]: r["value"] for r in L.parameter_labels(t, [0.01, 0.1]).collect()}
    assert got == {"pi0": 0.1, "mu": 1e-8, "W[-2,cds]": 0.4, "W[-1,cds]": 0.6}


def test_coordinates(spark):
    r = ranges(spark, [("a", 5, 9, "x")])
    assert rows(I.to_bed(r), "start") == [(4,)] and rows(I.to_gff(I.to_bed(r)), "start") == [(5,)]


def test_python_aggregate(spark):
    s = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 15, 7.0)], "chrom string, pos long, x double")
    spread = D.python_aggregate(lambda x: x.max() - x.min())
    got = rows(D.window_agg(s, I.tile(lengths(spark, a=20), 10), 10, spread=spread("x")), "bin", "spread")
    assert got == [(0, 2.0), (1, 0.0)]


def test_bias(spark):
    from popspark.operators.resample import bias_corrected

    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    r = bias_corrected(d, "x", spark.createDataFrame([(1.5,)], "estimate double")).first()
    assert (r["bias"], r["corrected"], r["stderr"]) == (0.5, 1.0, 1.0)
