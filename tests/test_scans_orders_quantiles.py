"""Block scans, global orders and exact quantiles against plain versions, whatever the block width."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import diversity as D, genmap, intervals as I, ordered, quantiles as Q, resample as B, scans, stats as T, tracks
from popspark.plans import bmap as M

WIDTHS = [1, 64, 1000, 1 << 22]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def some_ranges(spark, n=250, seed=1):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        s = rng.randrange(3000)
        made.append((rng.choice(["a", "a", "b"]), s, s + rng.choice([0, 1, 5, 30, 400 if k % 40 == 0 else 8]), rng.choice("xyz"), rng.randrange(9)))
    return made, spark.createDataFrame(made, "chrom string, start long, end long, feature string, score int")


def merged(made, gap=0):
    out = []
    for c, s, e, _, score in sorted(m for m in made if m[2] > m[1]):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1] = (c, out[-1][1], max(e, out[-1][2]), out[-1][3] + score)
        else:
            out.append((c, s, e, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", WIDTHS)
def test_merges_do_not_depend_on_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(scans, "BLOCK", width)
    made, df = some_ranges(spark)
    for gap in (0, 7):
        assert rows(I.merge(df, gap), "chrom", "start", "end") == [m[:3] for m in merged(made, gap)]
        assert rows(I.merge(df, gap, total=F.sum("score")), "chrom", "start", "end", "total") == merged(made, gap)
    n = spark.createDataFrame([("a", 5000), ("b", 4000), ("c", 9)], "chrom string, length long")
    want, at = [], {"a": 0, "b": 0, "c": 0}
    for c, s, e, _ in sorted(merged(made), key=lambda m: m[:3]):
        want += [(c, at[c], s)] if s > at[c] else []
        at[c] = e
    want += [(c, x, m) for (c, x), m in zip(sorted(at.items()), (5000, 4000, 9)) if m > x]
    assert rows(I.complement(df, n), "chrom", "start", "end") == sorted(want, key=repr)
    flags = dict(rows(I.contains_overlaps(df), "chrom", "overlapping"))
    assert flags == {"a": True, "b": True}
    assert dict(rows(I.contains_overlaps(I.merge(df)), "chrom", "overlapping")) == {"a": False, "b": False}


@pytest.mark.parametrize("width", WIDTHS)
def test_overlays_and_runs_do_not_depend_on_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(scans, "BLOCK", width)
    made, df = some_ranges(spark, 120, seed=2)
    best = {}
    for c, s, e, f, _ in made:
        for p in range(s, e):
            best[c, p] = min(best.get((c, p), "~"), f)
    want = []
    for (c, p), f in sorted(best.items()):
        if want and want[-1][0] == c and want[-1][2] == p and want[-1][3] == f:
            want[-1] = (c, want[-1][1], p + 1, f)
        else:
            want.append((c, p, p + 1, f))
    assert rows(I.overlay(df, ["x", "y", "z"]), "chrom", "start", "end", "feature") == sorted(want, key=repr)


@pytest.mark.parametrize("width", WIDTHS)
def test_maps_do_not_depend_on_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(scans, "BLOCK", width)
    rng = random.Random(3)
    pos = sorted(rng.sample(range(4900), 60))
    points = [("a", p, rng.random() * 3) for p in pos]
    m = genmap.recmap(spark.createDataFrame(points, "chrom string, pos long, rate double"), spark.createDataFrame([("a", 5000)], "chrom string, length long"))
    got = m.orderBy("start").collect()
    at = 0.0
    for r in got:
        assert r["cum_start"] == pytest.approx(at, abs=1e-15)
        at += (r["end"] - r["start"]) * r["rate"]
        assert r["cum_end"] == pytest.approx(at, abs=1e-15)
    assert [r["start"] for r in got] == ([0] if pos[0] else []) + pos
    cum = [("a", p, float(rng.randrange(30) if k % 9 == 0 else k)) for k, p in enumerate(pos)]
    kept = [(c, p, x) for k, (c, p, x) in enumerate(cum) if all(y <= x for *_, y in cum[:k]) and all(y >= x for *_, y in cum[k + 1 :])]
    assert rows(genmap.clean(spark.createDataFrame(cum, "chrom string, pos long, cum double")), "chrom", "pos", "cum") == sorted(kept, key=repr)
    assert rows(genmap.sorted_check(spark.createDataFrame(cum, "chrom string, pos long, cum double"), "cum"), "is_sorted") == [(all(a[2] <= b[2] for a, b in zip(cum, cum[1:])),)]
    knots = spark.createDataFrame([("a", p, float(p * p)) for p in pos], "chrom string, pos long, log_b double").withColumns({"wi": F.lit(0), "ti": F.lit(0), "feature": F.lit("f")})
    binned = {r["bin"]: r["log_b"] for r in M.bin_map(knots, 500).collect()}
    want: dict = {}
    for p, q in zip(pos, pos[1:]):
        want.setdefault(int((p + q) / 2 // 500), []).append((p * p + q * q) / 2)
    assert binned == pytest.approx({k: np.mean(v) for k, v in want.items()})


def test_split_of_unrated_parts(spark):
    f = spark.createDataFrame([("a", 0, 50, "x")], "chrom string, start long, end long, feature string")
    m = spark.createDataFrame([("a", 0, 30, 1e-8, 0.0), ("a", 40, 60, 1e-8, 1e-6)], "chrom string, start long, end long, rate double, cum_start double")
    with pytest.raises(Exception, match="no rate at a:30"):
        I.split(f, m, 20).count()
    assert rows(I.split(f, m, 20, strict=False), "start", "end") == [(0, 20), (20, 30), (40, 50)]
    whole = m.unionByName(spark.createDataFrame([("a", 30, 40, 0.0, 3e-7)], m.schema))
    assert rows(I.split(f, whole), "start", "end") == [(0, 30), (30, 40), (40, 50)]


def plain_stencil(y, weights):
    """Mirror images around the end values, written out."""
    half, n = len(weights) // 2, len(y)

    def at(i):
        if i < 0:
            return y[0] - abs(y[-i] - y[0])
        return y[-1] + abs(y[2 * (n - 1) - i] - y[-1]) if i >= n else y[i]

    return [sum(w * at(k + d) for d, w in zip(range(-half, half + 1), weights)) for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, 16, None])
def test_stencils_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "ROWS", block or 1 << 16)
    rng = random.Random(4)
    series = {"a": [rng.random() for _ in range(50)], "b": [rng.random() for _ in range(9)]}
    # bins with gaps: neighbours are rows, not bins
    made = [(c, 3 * k + k // 7, x) for c, xs in series.items() for k, x in enumerate(xs)]
    weights = T.savitzky_golay_weights(5, 2)
    got = T.stencil(spark.createDataFrame(made, "chrom string, bin int, y double"), "y", weights, block=block).orderBy("chrom", "bin").collect()
    assert [r["smooth"] for r in got] == pytest.approx(plain_stencil(series["a"], weights) + plain_stencil(series["b"], weights))


def test_numbers_and_blocks_of_windows(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROWS", 4)
    w = spark.createDataFrame([(c, b) for c in "ab" for b in (0, 2, 3, 9, 14, 15, 30)], "chrom string, bin int")
    assert rows(D.blocks(w, 3), "chrom", "bin", "block")[:7] == sorted(zip("a" * 7, (0, 2, 3, 9, 14, 15, 30), (0, 0, 0, 1, 1, 1, 2)), key=repr)
    assert D.moving_blocks(w, 3).groupBy("chrom", "block").count().filter("count = 3").count() == 10


# -- quantiles ------------------------------------------------------------------------------------------------------


def exact_of(values, probs):
    return [float(np.quantile(values, p)) for p in probs] if len(values) else [None] * len(probs)


PROBS = [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]


@pytest.mark.parametrize("case", ["normal", "ties", "hot", "few", "one", "none"])
@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 1_000_000), (50, 40), (20, 5)])
def test_exact_quantiles(spark, case, accuracy, most):
    rng = np.random.default_rng(5)
    n = {"few": 3, "one": 1, "none": 0}.get(case, 4000)
    values = rng.integers(0, 12, n).astype(float) if case == "ties" else rng.normal(size=n)
    if case == "hot":
        values[: n // 2] = 0.125
    rng.shuffle(values)
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)] * 5, "v double").repartition(6)
    got = Q.exact(df, "v", PROBS, accuracy, most)
    want = exact_of(values, PROBS)
    assert got == want or got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_exact_quantiles_equal_the_builtin(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(7919)) / 3).alias("v"))
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert Q.exact(df, "v", PROBS, 200, 100) == want


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_grouped_quantiles(spark, accuracy):
    rng = np.random.default_rng(6)
    made = [(g, float(x)) for g, n in (("hot", 3000), ("small", 7), ("one", 1), (None, 40)) for x in np.round(rng.normal(size=n), 2)] + [("none", None)]
    df = spark.createDataFrame(made, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in Q.grouped(df, ["g"], "v", PROBS, accuracy).collect()}
    assert set(got) == {"hot", "small", "one", None}
    for g, q in got.items():
        assert q == pytest.approx(exact_of([v for k, v in made if k == g], PROBS), abs=1e-12)


def test_no_plan_sorts_or_collects_a_whole_column(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    for made in (tracks.quantile_classes(df.withColumnRenamed("x", "value"), [0.5]), tracks.censor(df, "x", 0.1, 0.9), T.count_classes(df, "x", 4), T.describe(df, "x"), T.binned(df, "x", "y", [0.0, 0.5, 1.0]), T.box(df, "g", "x")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan  # the exact one keeps all values of a group
        made.collect()


def test_trimmed_errors_and_bands(spark):
    rng = np.random.default_rng(7)
    made = [(g, float(x)) for g in "ab" for x in rng.normal(size=60)]
    df = spark.createDataFrame(made, "g string, v double")
    got = {r["g"]: r for r in B.bands(df, ["g"], "v", 0.1).collect()}
    for g in "ab":
        v = [x for k, x in made if k == g]
        assert (got[g]["lower"], got[g]["median"], got[g]["upper"]) == pytest.approx(tuple(np.quantile(v, [0.05, 0.5, 0.95])))
    errors = {r["g"]: r for r in B.jackknife_error(df, ["g"], "v", trim=0.1).collect()}
    for g in "ab":
        v = np.array([x for k, x in made if k == g])
        lo, hi = np.quantile(v, [0.1, 0.9])
        kept = v[(v >= lo) & (v <= hi)]
        assert errors[g]["n"] == len(kept) and errors[g]["stderr"] == pytest.approx(np.sqrt((len(kept) - 1) * kept.var()))


# -- global order -----------------------------------------------------------------------------------------------------


def test_numbers_over_the_whole_table(spark):
    made = [(k % 7 if k % 3 else 5, None if k % 50 == 0 else k, "t") for k in range(900)] + [(5, 1, "same")] * 60
    df = spark.createDataFrame(made, "x int, y int, z string").repartition(7)
    got = ordered.numbered(df, ["x", "y"]).collect()
    assert sorted(r["nth"] for r in got) == list(range(len(made)))
    along = [(r["x"], r["y"] is not None, r["y"] or 0) for r in sorted(got, key=lambda r: r["nth"])]
    assert along == sorted(along)
    assert ordered.numbered(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize(("n", "k"), [(103, 5), (100, 4), (3, 5)])
def test_contiguous_folds(spark, n, k):
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"))
    got = sorted((r["x"], r["fold"]) for r in ordered.folds(df, ["x"], k).collect())
    sizes = [sum(f == j for _, f in got) for j in range(k)]
    assert sizes == [len(a) for a in np.array_split(np.arange(n), k)]
    assert all(max(x for x, f in got if f == j) <= min(x for x, f in got if f == j + 1) for j in range(k - 1) if sizes[j + 1])


def test_draws_with_replacement(spark):
    df = spark.range(400).select(F.col("id").alias("v"))
    got = ordered.drawn(df, 30, seed=3).groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d"), F.avg("v").alias("m")).collect()
    assert len(got) == 30 and {r["n"] for r in got} == {400}
    assert 0.58 < np.mean([r["d"] for r in got]) / 400 < 0.68  # 1 - 1 / e
    assert abs(np.mean([r["m"] for r in got]) - 199.5) < 5 and np.std([r["m"] for r in got]) == pytest.approx(115.5 / 20, rel=0.5)


def test_small_tables_are_one_block(spark, tmp_path):
    made, df = some_ranges(spark, 200, seed=9)
    df.write.parquet(str(tmp_path / "r"))
    small = spark.read.parquet(str(tmp_path / "r"))
    assert "__whole" in scans.blocked(small, "start").columns and "__whole" not in scans.blocked(df, "start").columns
    n = spark.createDataFrame([("a", 5000), ("b", 4000)], "chrom string, length long")
    for f in (lambda d: I.merge(d), lambda d: I.merge(d, 3, total=F.sum("score")), lambda d: I.complement(d, n), lambda d: I.overlay(d, ["x", "y", "z"]), lambda d: I.contains_overlaps(d)):
        assert f(small).columns == f(df).columns and rows(f(small), *f(df).columns) == rows(f(df), *f(df).columns)
    bins = small.select("chrom", F.col("start").alias("bin"), "score").dropDuplicates(["chrom", "bin"])
    bins.write.parquet(str(tmp_path / "b"))
    one = spark.read.parquet(str(tmp_path / "b"))
    assert rows(scans.numbered(one, ["chrom"], "bin", "k"), "chrom", "bin", "k") == rows(scans.numbered(spark.createDataFrame(one.collect(), one.schema), ["chrom"], "bin", "k"), "chrom", "bin", "k")
