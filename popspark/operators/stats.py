"""Summaries, correlations, smoothers and regressions of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.operators import ordered, quantiles, scans


def describe(rows: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, variance (population), extremes, quantiles and total of a column."""
    c = F.col(column)
    found = dict(zip((0.1, 0.25, 0.5, 0.9), quantiles.exact(rows, column, [0.1, 0.25, 0.5, 0.9])))
    q = lambda p: F.lit(found[p]).cast("double")
    return rows.agg(
        F.avg(c).alias("mean"), q(0.5).alias("median"), F.var_pop(c).alias("var"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.min(F.when(c != 0, c)).alias("non_zero_min"), q(0.1).alias("lower10"), q(0.25).alias("q25"), q(0.9).alias("upper10"), F.sum(c).alias("total"),
    )


def cut_edges(rows: DataFrame, x: str, n: int, method: str = "interval") -> list[float]:
    """``n`` + 1 edges of equal width or equal count; the few numbers are what a driver loop needs."""
    if method == "interval":
        lo, hi = rows.agg(F.min(x), F.max(x)).first()
        return [lo + (hi - lo) * k / n for k in range(n + 1)]
    probs = [k / n for k in range(n + 1)]
    return quantiles.exact(rows, x, probs)


def binned(rows: DataFrame, x: str, y: str, edges: list[float], stats: dict[str, Column] | None = None) -> DataFrame:
    """Summaries of ``y`` between edges of ``x``; a bin holds its left edge, the last one both."""
    e = F.array(*[F.lit(float(v)) for v in edges])
    k = F.least(F.size(F.filter(e, lambda v: v <= F.col(x))), F.lit(len(edges) - 1)) - 1
    names = list(stats or ("mean", "median", "sd", "n"))
    plain = stats or {"mean": F.avg(y), "sd": F.stddev_pop(y), "n": F.count(y)}
    inside = rows.filter((F.col(x) >= edges[0]) & (F.col(x) <= edges[-1])).withColumn("bin", k)
    out = inside.groupBy("bin").agg(*[c.alias(n) for n, c in plain.items()])
    if not stats:
        out = out.join(quantiles.grouped(inside, ["bin"], y, [0.5]).select("bin", F.col("q")[0].alias("median")), "bin", "left")
    return out.select("bin", e[F.col("bin")].alias("start"), e[F.col("bin") + 1].alias("end"), *names)


def cut_tails(rows: DataFrame, x: str, share: float) -> DataFrame:
    """Rows without ``share`` of the values of ``x`` at either end."""
    lo, hi = quantiles.exact(rows, x, [share, 1 - share])
    return rows.filter(F.col(x).between(F.lit(lo), F.lit(hi)))


def ranked(rows: DataFrame, column: str, out: str, blocks: int = 256) -> DataFrame:
    """Mid ranks of a numeric column.

    Distinct values are cut into about ``blocks`` ranges; a window sorts one range, and what lies before it comes
    from the counts of the ranges, so no task sees all values.
    """
    n = rows.groupBy(column).agg(F.count("*").alias("__n"))
    cuts = n.agg(F.percentile_approx(column, [k / blocks for k in range(1, blocks)])).first()[0] or []
    block = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(column))) if cuts else F.lit(0)
    n = n.withColumn("__b", block)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = n.groupBy("__b").agg(F.sum("__n").alias("__m")).select("__b", earlier("__m", W.orderBy("__b")).alias("__first"))
    before = F.col("__first") + earlier("__n", W.partitionBy("__b").orderBy(column))
    r = n.join(F.broadcast(first), "__b").select(F.col(column).alias("__v"), (before + (F.col("__n") + 1) / 2).alias(out))
    return rows.join(r, rows[column] == r["__v"]).drop("__v")


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation over complete pairs."""
    p = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    r = ranked(ranked(p, "x", "rx"), "y", "ry")
    return r.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def weighted_mean(rows: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("mean"))


def coefficient_of_variation(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.stddev_pop(x) / F.avg(x)).alias("cv"), F.var_pop(x).alias("variance"))


def fit_r(rows: DataFrame, observed: str, predicted: str) -> DataFrame:
    """Correlation of predictions with observations and its square, each under its own name."""
    r = F.corr(observed, predicted)
    return rows.agg(r.alias("r"), (r * r).alias("r2"), F.count("*").alias("n"))


def errors(rows: DataFrame, by: list[str], truth: str, estimates: list[str]) -> DataFrame:
    """MSE, mean relative error and bias of several estimates."""
    t = F.col(truth)
    out = []
    for e in estimates:
        d = F.col(e) - t
        out += [F.avg(d * d).alias(f"{e}_mse"), F.avg(F.abs(1 - F.col(e) / t)).alias(f"{e}_relerror"), F.avg(d).alias(f"{e}_bias")]
    return rows.groupBy(*by).agg(*out)


def covariance_sum(rows: DataFrame, unit: str, locus: str, value: str) -> DataFrame:
    """Sum over pairs of loci of their covariance over units: (Var of sums - sum of Vars) / 2."""
    sums = rows.groupBy(unit).agg(F.sum(value).alias("s")).agg(F.var_samp("s").alias("of_sum"))
    each = rows.groupBy(locus).agg(F.var_samp(value).alias("v")).agg(F.sum("v").alias("of_each"))
    return sums.crossJoin(each).select(((F.col("of_sum") - F.col("of_each")) / 2).alias("ld_sum"))


def histogram(rows: DataFrame, x: str, edges: list[float], density: bool = False) -> DataFrame:
    """Counts between edges, empty bins included; the last bin holds its right edge."""
    got = binned(rows.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))), x, x, edges, {"n": F.count(x)}).select("bin", "n")
    bins = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(got, "bin", "left").fillna(0, ["n"])
    e = F.array(*[F.lit(float(v)) for v in edges])
    out = out.select("bin", e[F.col("bin")].alias("start"), e[F.col("bin") + 1].alias("end"), "n")
    if density:
        total = out.agg(F.sum("n").alias("t"))
        out = out.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / F.col("t") / (F.col("end") - F.col("start"))).drop("t")
    return out


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return [10 ** (math.log10(lo) + (math.log10(hi) - math.log10(lo)) * k / n) for k in range(n + 1)]


def box(rows: DataFrame, by: str, x: str) -> DataFrame:
    q = quantiles.grouped(rows, [by], x, [0.25, 0.5, 0.75])
    return rows.groupBy(by).agg(F.avg(x).alias("mean")).join(q, by, "left").select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean")


def stencil(rows: DataFrame, y: str, weights: list[float], out: str = "smooth", by: str = "chrom", order: str = "bin", block: int | None = None) -> DataFrame:
    """Weighted sum of a series and its neighbours along the integer ``order``; beyond the ends it is mirrored around the end values.

    With v the end value and y the value as far inside, the image is v - |y - v| before the start and v + |y - v| after
    the end.  Rows are numbered and cut into blocks that also hold copies of their neighbours' border rows.
    """
    half = len(weights) // 2
    r = scans.numbered(rows, [by], order, "__k")
    ends = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.min_by(y, order).alias("__first"), F.max_by(y, order).alias("__last"))
    r = scans.neighbours(r, [by], "__k", y, half, "__a", block)
    r = r.join(ends, F.col(by).eqNullSafe(F.col("__by")))
    lowest = F.greatest(F.lit(0), F.col("__k") - half)
    at = lambda pos: F.get("__a", (pos - lowest).cast("int"))
    total = F.lit(0.0)
    for d, c in zip(range(-half, half + 1), weights):
        p = F.col("__k") + d
        last = F.col("__n") - 1
        value = F.when(p < 0, F.col("__first") - F.abs(at(-p) - F.col("__first"))).when(p > last, F.col("__last") + F.abs(at(2 * last - p) - F.col("__last"))).otherwise(at(p))
        total = total + value * c
    return r.select(*rows.columns, total.alias(out))


def savitzky_golay_weights(size: int, order: int, deriv: int = 0) -> list[float]:
    """Least-squares polynomial weights of a window of odd ``size``."""
    import numpy as np

    half = (size - 1) // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return (np.linalg.pinv(basis)[deriv] * math.factorial(deriv)).tolist()


def gaussian_weights(sd: float, reach: float = 4.0) -> list[float]:
    half = int(reach * sd + 0.5)
    w = [math.exp(-0.5 * (k / sd) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_kernel(u: Column) -> Column:
    return F.exp(-u * u / 2) / math.sqrt(2 * math.pi)


def kernel_regression(rows: DataFrame, targets: DataFrame, x: str, y: str, h: float, kernel=gaussian_kernel) -> DataFrame:
    """Kernel-weighted mean of ``y`` at each target ``at``; every target sees all rows, targets are few and broadcast."""
    k = kernel((F.col("at") - F.col(x)) / h)
    return rows.crossJoin(F.broadcast(targets)).groupBy("at").agg((F.sum(k * F.col(y)) / F.sum(k)).alias("fit"))


def lowess(rows: DataFrame, targets: DataFrame, x: str, y: str, frac: float) -> DataFrame:
    """Local linear fit at each target ``at`` with tricube weights over the nearest ``frac`` of the rows."""
    n = rows.count()
    k = max(2, math.ceil(frac * n))
    d = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).crossJoin(F.broadcast(targets)).withColumn("d", F.abs(F.col("x") - F.col("at")))
    reach = d.groupBy("at").agg(F.percentile("d", F.lit((k - 1) / max(1, n - 1))).alias("h"))
    d = d.join(F.broadcast(reach), "at").filter("d < h OR h = 0")
    u = F.when(F.col("h") > 0, F.col("d") / F.col("h")).otherwise(0.0)
    w = F.pow(1 - u * u * u, F.lit(3))
    d = d.withColumns({"w": w, "c": F.col("x") - F.col("at")})
    s = d.groupBy("at").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("c")).alias("wx"), F.sum(F.col("w") * F.col("c") * F.col("c")).alias("wxx"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("c") * F.col("y")).alias("wxy"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    line = (F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / det
    return s.select("at", F.when(F.abs(det) > 1e-12, line).otherwise(F.col("wy") / F.col("w")).alias("fit"))


def linear_regression(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope, intercept, r, r2 and the slope's standard error."""
    slope, r = F.regr_slope(y, x), F.corr(y, x)
    sd = F.sqrt((1 - r * r) * F.regr_syy(y, x) / F.regr_sxx(y, x) / (F.regr_count(y, x) - 2))
    aggs = slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), r.alias("r"), (r * r).alias("r2"), sd.alias("stderr")
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def cv_bins(rows: DataFrame, x: str, y: str, choices: list[int], folds: int = 5) -> DataFrame:
    """Cross-validated error of predicting ``y`` by its mean in equal-width bins of ``x``, for each number of bins."""
    lo, hi = rows.agg(F.min(x), F.max(x)).first()
    r = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).withColumn("fold", F.pmod(F.xxhash64("x", "y"), F.lit(folds)))
    r = r.withColumn("nbins", F.explode(F.array(*[F.lit(c) for c in choices])))
    r = r.withColumn("bin", F.least(F.floor((F.col("x") - lo) / (hi - lo) * F.col("nbins")), F.col("nbins") - 1))
    per = r.groupBy("nbins", "bin", "fold").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.count("*").alias("n"))
    w = W.partitionBy("nbins", "bin")
    other_s, other_n = F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")
    mean = other_s / F.nullif(other_n, F.lit(0))
    sse = F.col("ss") - 2 * mean * F.col("s") + F.col("n") * mean * mean
    return per.select("nbins", sse.alias("e"), F.when(other_n > 0, F.col("n")).alias("n")).groupBy("nbins").agg((F.sum("e") / F.sum("n")).alias("mse"))


def cv_bins_contiguous(rows: DataFrame, x: str, y: str, by: list[str], choices: list[int], folds: int = 5) -> DataFrame:
    """Cross-validated error for each number of equal-width bins, over contiguous folds of the rows in the order of ``by``.

    A fold's error is the mean squared one of its rows, each weighted by how many training rows its bin has; the result is the mean
    over folds.  Bins reach from the least x to 1.001 times the greatest; rows in bins without training rows do not count.
    """
    lo, hi = rows.agg(F.min(x), F.max(x) * 1.001).first()
    r = ordered.folds(rows.select(F.col(x).alias("x"), F.col(y).alias("y"), *by), by, folds)
    r = r.withColumn("nbins", F.explode(F.array(*[F.lit(c) for c in choices])))
    r = r.withColumn("bin", F.floor((F.col("x") - lo) / (hi - lo) * F.col("nbins")))
    per = r.groupBy("nbins", "bin", "fold").agg(F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"), F.count("*").alias("n"))
    w = W.partitionBy("nbins", "bin")  # a row for each fold
    other_s, other_n = F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")
    mean = other_s / F.nullif(other_n, F.lit(0))
    sse = F.col("ss") - 2 * mean * F.col("s") + F.col("n") * mean * mean
    one = per.select("nbins", "fold", sse.alias("e"), other_n.alias("w"), "n").filter("w > 0")
    one = one.groupBy("nbins", "fold").agg((F.sum(F.col("w") * F.col("e")) / F.sum(F.col("w") * F.col("n"))).alias("mse"))
    return one.groupBy("nbins").agg(F.avg("mse").alias("mse"))


def slope_after(rows: DataFrame, by: list[str], at: str, y: str, first: float) -> DataFrame:
    """Slope of ``y`` along ``at`` in each group, from ``first`` on; groups with fewer than two points have none."""
    kept = rows.filter(F.col(at) >= first)
    out = kept.groupBy(*by).agg(F.regr_slope(y, at).alias("slope"), F.count("*").alias("n"))
    return out.filter("n > 1").drop("n")


def best_bins(errors_by_bins: DataFrame) -> DataFrame:
    """The row of least error of ``cv_bins``; of equal ones that with fewest bins."""
    return errors_by_bins.orderBy("mse", "nbins").limit(1)


def softmax(rows: DataFrame, x: str, by: list[str], out: str = "weight") -> DataFrame:
    w = W.partitionBy(*by)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return rows.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def count_classes(rows: DataFrame, x: str, n: int) -> DataFrame:
    """Equal-count classes 0..n-1 by quantile edges."""
    edges = cut_edges(rows.filter(F.col(x).isNotNull()), x, n, "count")
    e = F.array(*[F.lit(float(v)) for v in edges[1:-1]])
    return rows.withColumn("class", F.size(F.filter(e, lambda v: v < F.col(x))))


def long_form(rows: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def wide_form(rows: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value", error: str | None = None) -> DataFrame:
    """Back from the long form: a column for each of ``values`` of ``name``; with ``error`` also ``<name>_<error>``."""
    columns = [F.first(F.when(F.col(name) == v, F.col(c)), ignorenulls=True).alias(v if c == value else f"{v}_{c}") for v in values for c in (value, error) if c]
    return rows.groupBy(*ids).agg(*columns)


def midpoints(rows: DataFrame, x: str, by: str, order: str) -> DataFrame:
    """Midpoint of each value and the next."""
    nxt = F.lead(x).over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("midpoint", (F.col(x) + nxt) / 2)
