"""Bootstrap and collection of repeated fits.  Random numbers are hashes of seed and row, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.functions import scalars as S
from popspark.operators import quantiles as Q, scans
from popspark.operators.ordered import kept


def unit_random(seed: int, *columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * F.lit(2.0**-53)


def block_bootstrap(windows: DataFrame, k: int, replicates: int, seed: int, last_start: bool = True) -> DataFrame:
    """``windows`` of each replicate: draws of ``k`` consecutive windows, n / k of them, until as many as there are.

    A chromosome is drawn in proportion to its windows and a start uniformly in it; without ``last_start`` the last
    possible start is never drawn.  Windows are read more than once and so are kept.  Each is copied for the ``k`` blocks that
    hold it, so a draw meets its windows as one row.  Spark may estimate made rows at a few bytes and send them all through the
    driver, hence the hint.
    """
    windows = kept(windows)
    w = scans.numbered(windows, ["chrom"], "bin", "__nth")
    sizes = windows.groupBy("chrom").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    order = W.orderBy("chrom")
    sizes = sizes.withColumns({"hi": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    total = sizes.agg(F.max("total")).first()[0] or 0
    each = max(1, total // k)
    draw = (F.col("id") % each + 1).cast("int" if each < 1 << 31 else "long")  # its type is part of the hash
    draws = windows.sparkSession.range(replicates * each).select(F.floor(F.col("id") / each).alias("replicate"), draw.alias("draw"))
    at = unit_random(seed, "replicate", "draw") * total
    picked = draws.withColumn("__u", at).join(F.broadcast(sizes), (F.col("__u") >= F.col("hi") - F.col("n")) & (F.col("__u") < F.col("hi")))
    starts = F.col("n") - k + (1 if last_start else 0)
    first = F.floor(unit_random(seed + 1, "replicate", "draw") * F.greatest(starts, F.lit(1)))
    blocks = picked.select("replicate", "draw", "chrom", first.alias("__first"))
    holding = F.sequence(F.greatest(F.lit(0), F.col("__nth") - k + 1), F.col("__nth"))
    return blocks.join(w.withColumn("__first", F.explode(holding)).drop("__nth").hint("merge"), ["chrom", "__first"]).drop("__first")


def bootstrap_pi(drawn: DataFrame) -> DataFrame:
    """pi of each replicate from its summed pairs."""
    return drawn.groupBy("replicate").agg(S.pi(F.sum("n_same"), F.sum("n_diff")).alias("pi"), F.count("*").alias("n_windows"))


def row_bootstrap(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Each row of each replicate as often as a Poisson(1) draw says: a bootstrap of rows without a global index."""
    copy = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = unit_random(seed, "__id", "replicate")
    cuts, p, c = [], 0.36787944117144233, 0.0
    for n in range(1, 12):
        c += p
        cuts.append(c)
        p /= n
    times = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= u))
    return copy.withColumn("__t", times).filter("__t > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__id", "__t", "__c")


def interval(draws: DataFrame, column: str, estimate: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile and pivot interval of replicate values around ``estimate`` (one row, column estimate)."""
    lower, upper = Q.exact(draws, column, [alpha / 2, 1 - alpha / 2])
    both = estimate.select(F.lit(lower).cast("double").alias("lower"), F.lit(upper).cast("double").alias("upper"), *estimate.columns)
    return both.withColumns({"pivot_lower": 2 * F.col("estimate") - F.col("upper"), "pivot_upper": 2 * F.col("estimate") - F.col("lower")})


def best_runs(runs: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` runs of least value with their place; a top-k, so no full sort meets in one task."""
    top = runs.orderBy(value).limit(k)
    return top.withColumn("place", F.rank().over(W.orderBy(value)))


def collect_runs(runs: DataFrame, code: str, value: str) -> DataFrame:
    """By end code: runs, share of all, and least value."""
    per = runs.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.min(value).alias("best"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("code", "n", (F.col("n") / F.col("t")).alias("fraction"), "best")


def jackknife_error(estimates: DataFrame, by: list[str], column: str, trim: float | None = None, iqr: float | None = None) -> DataFrame:
    """Delete-one standard error sqrt((n - 1) / n * sum (x - mean)^2).

    ``trim``: quantile cut from both tails; ``iqr``: values further from the median than so many interquartile
    ranges are left out.
    """
    e = estimates
    if trim:
        q = Q.grouped(e, by, column, [trim, 1 - trim])
        e = e.join(q, by).filter(F.col(column).between(F.col("q")[0], F.col("q")[1])).drop("q")
    if iqr:
        q = Q.grouped(e, by, column, [0.25, 0.5, 0.75])
        e = e.join(q, by).filter(F.abs(F.col(column) - F.col("q")[1]) <= iqr * (F.col("q")[2] - F.col("q")[0])).drop("q")
    n = F.count(column)
    return e.groupBy(*by).agg(F.avg(column).alias("mean"), F.sqrt((n - 1) * F.var_pop(column)).alias("stderr"), n.alias("n"))


def sigma_interval(rows: DataFrame, estimate: str, stderr: str = "stderr", factor: float = 1.0) -> DataFrame:
    """``rows`` with the ends of estimate +- factor * stderr."""
    half = factor * F.col(stderr)
    return rows.withColumns({"lower": F.col(estimate) - half, "upper": F.col(estimate) + half})


def bands(draws: DataFrame, by: list[str], column: str, alpha: float = 0.05) -> DataFrame:
    """Percentile band, mean and median over the replicates at each point ``by``."""
    q = Q.grouped(draws, by, column, [alpha / 2, 0.5, 1 - alpha / 2])
    out = draws.groupBy(*by).agg(F.avg(column).alias("mean")).join(q, by)
    return out.select(*by, "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"))


def regression_band(rows: DataFrame, targets: DataFrame, x: str, y: str, replicates: int = 200, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """Percentile band of the regression line at each target ``at``, from lines through bootstrapped rows."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    lines = row_bootstrap(pairs, replicates, seed).groupBy("replicate").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    fits = targets.join(F.broadcast(lines)).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("at"))  # a line for each replicate
    return bands(fits, ["at"], "fit", alpha)


def bias_corrected(draws: DataFrame, column: str, estimate: DataFrame) -> DataFrame:
    """Bias of an estimate (one row, column estimate) by its replicates, their deviation, and the estimate less the bias."""
    s = draws.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("stderr"))
    both = s.crossJoin(F.broadcast(estimate))
    return both.select("estimate", "stderr", (F.col("__m") - F.col("estimate")).alias("bias"), (2 * F.col("estimate") - F.col("__m")).alias("corrected"))
