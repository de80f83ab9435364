"""Diversity from allele counts: masking, windows, flags and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.functions import scalars as S
from popspark.operators import intervals, quantiles, scans
from popspark.operators.rangejoin import BUCKET, inside_all


def mask_sites(sites: DataFrame, neutral: DataFrame | None = None, accessible: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """Sites inside every mask that is given; a masked site is an absent row."""
    return inside_all(sites, [mask for mask in (neutral, accessible) if mask is not None], bucket)


def pair_counts(sites: DataFrame) -> DataFrame:
    return sites.withColumns({"n_same": S.n_same(F.col("n_ref"), F.col("n_alt")), "n_diff": S.n_diff(F.col("n_ref"), F.col("n_alt"))})


def window_pairs(sites: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Every window with its sums of same and different pairs, its sites with a comparison, and pi.

    Sites may come with their window ``bin``; if they are dealt by it, their sums need no shuffle.
    """
    at = F.col("bin") if "bin" in sites.columns else F.floor(F.col("pos") / width).cast("int").alias("bin")
    compared = (F.col("n_same") + F.col("n_diff")) > 0
    p = pair_counts(sites).groupBy("chrom", at)
    p = p.agg(F.sum("n_same").alias("n_same"), F.sum("n_diff").alias("n_diff"), F.sum(compared.cast("long")).alias("n_sites"))
    w = windows.join(p, ["chrom", "bin"], "left").fillna(0, ["n_same", "n_diff", "n_sites"])
    return w.withColumn("pi", S.pi(F.col("n_same"), F.col("n_diff")))


def window_agg(rows: DataFrame, windows: DataFrame, width: int, pos: str = "pos", per_base: bool = False, **aggs: Column) -> DataFrame:
    """Named aggregates of each window; ``per_base`` divides sums by the window's width, absent rows then count 0."""
    p = rows.groupBy("chrom", F.floor(F.col(pos) / width).cast("int").alias("bin")).agg(*[c.alias(n) for n, c in aggs.items()])
    w = windows.join(p, ["chrom", "bin"], "left")
    if per_base:
        w = w.withColumns({n: F.coalesce(F.col(n), F.lit(0)) / (F.col("end") - F.col("start")) for n in aggs})
    return w


def edge_agg(rows: DataFrame, edges: list[float], column: str, **aggs: Column) -> DataFrame:
    """Named aggregates between given edges; values outside are left out."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    k = F.size(F.filter(e, lambda x: x <= F.col(column)))
    inside = rows.withColumn("bin", k - 1).filter((k > 0) & (k < len(edges)))
    return inside.groupBy("bin").agg(*[c.alias(n) for n, c in aggs.items()])


def flag_accessible(windows: DataFrame, accessible: DataFrame, most_masked: float = 0.7) -> DataFrame:
    """``keep``: whether less than ``most_masked`` of the window is inaccessible."""
    c = intervals.coverage(windows.select("chrom", "bin", "start", "end"), accessible)
    return windows.join(c.select("chrom", "bin", (1 - F.col("fraction") < most_masked).alias("keep")), ["chrom", "bin"])


def flag_outliers(windows: DataFrame, low: float, high: float, combine: str = "replace") -> DataFrame:
    """``keep``: pi strictly between its quantiles over the kept windows; ``and`` adds this to an earlier flag."""
    kept = F.col("keep") if "keep" in windows.columns else F.lit(True)
    lower, upper = quantiles.exact(windows.filter(kept), "pi", [low, high])
    ok = F.coalesce((F.col("pi") > F.lit(lower)) & (F.col("pi") < F.lit(upper)), F.lit(False))
    return windows.withColumn("keep", ok & kept if combine == "and" else ok)


def chromosome_pi(sites: DataFrame, by_pairs: bool = True) -> DataFrame:
    """pi of each chromosome with its weight, and the weighted mean as the row with a null chrom."""
    p = pair_counts(sites).groupBy("chrom").agg(F.sum("n_same").alias("s"), F.sum("n_diff").alias("d"), F.count("*").cast("double").alias("n"))
    per = p.select("chrom", S.pi(F.col("s"), F.col("d")).alias("pi"), (F.col("s") + F.col("d") if by_pairs else F.col("n")).alias("weight"))
    all_ = per.agg((F.sum(F.col("pi") * F.col("weight")) / F.sum("weight")).alias("pi"), F.sum("weight").alias("weight"))
    return per.unionByName(all_.select(F.lit(None).cast("string").alias("chrom"), "pi", "weight"))


def polymorphic(sites: DataFrame) -> DataFrame:
    """For each chromosome: non-zero count cells, and sites where both alleles were seen."""
    cells = (F.col("n_ref") > 0).cast("long") + (F.col("n_alt") > 0).cast("long")
    return sites.groupBy("chrom").agg(F.sum(cells).alias("cells"), F.sum(((F.col("n_ref") > 0) & (F.col("n_alt") > 0)).cast("long")).alias("polymorphic"))


def mask_stats(neutral: DataFrame, accessible: DataFrame, seqlens: DataFrame) -> DataFrame:
    """Share of each chromosome that is neutral, accessible, and both."""

    def share(ranges, name):
        r = intervals.merge(ranges).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias(name))
        return r

    out = seqlens
    both = intervals.intersect(intervals.merge(neutral), intervals.merge(accessible))
    for ranges, name in ((neutral, "neutral"), (accessible, "accessible"), (both, "both")):
        out = out.join(share(ranges, name), "chrom", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)) / F.col("length"))
    return out.drop("length")


def feature_stats(features: DataFrame, seqlens: DataFrame) -> DataFrame:
    """Count, bases and share of the seen chromosomes by (chrom, feature) and, with a null chrom, by feature."""
    size = F.col("end") - F.col("start")
    f = features.join(seqlens, "chrom").withColumn("size", size)
    total = f.select("chrom", "length").distinct().agg(F.sum("length").alias("total"))
    g = f.groupingSets([[F.col("chrom"), F.col("feature")], [F.col("feature")]], "chrom", "feature").agg(F.count("*").alias("n"), F.sum("size").alias("bases"), F.max("length").alias("length"))
    g = g.crossJoin(F.broadcast(total))
    return g.select("chrom", "feature", "n", "bases", (F.col("bases") / F.when(F.col("chrom").isNull(), F.col("total")).otherwise(F.col("length"))).alias("fraction"))


def lagged(windows: DataFrame, lags: int, column: str = "pi", where: str | None = None, func=lambda a, b: (a - b) * (a - b)) -> DataFrame:
    """For each lag up to ``lags``: mean of ``func`` over pairs of windows of one chromosome, mean distance, pairs.

    ``where``: column whose difference is the distance (bases or map positions).
    """
    where = where or "start"
    one = windows.filter(F.col(column).isNotNull()).select("chrom", "bin", F.col(column).alias("y"), F.col(where).alias("x"))
    far = one.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("bin", F.col("bin") + F.col("lag")).withColumnsRenamed({"y": "y0", "x": "x0"})
    j = far.join(one, ["chrom", "bin"])
    return j.groupBy("lag").agg(F.avg(func(F.col("y0"), F.col("y"))).alias("stat"), F.avg(F.abs(F.col("x") - F.col("x0"))).alias("distance"), F.count("*").alias("n"))


def blocks(windows: DataFrame, k: int) -> DataFrame:
    """``block``: consecutive groups of ``k`` windows of a chromosome."""
    return scans.numbered(windows, ["chrom"], "bin", "__nth").withColumn("block", F.floor(F.col("__nth") / k).cast("int")).drop("__nth")


def moving_blocks(windows: DataFrame, k: int) -> DataFrame:
    """Each window once for every block of ``k`` consecutive windows that holds it; ``block``: the block's first."""
    sizes = windows.groupBy("chrom").agg(F.count("*").alias("__n"))
    r = scans.numbered(windows, ["chrom"], "bin", "__nth").join(sizes, "chrom")
    first, last = F.greatest(F.lit(0), F.col("__nth") - k + 1), F.least(F.col("__nth"), F.col("__n") - k)
    r = r.withColumns({"__first": first, "__last": last}).filter("__first <= __last")
    return r.select("*", F.explode(F.sequence("__first", "__last")).alias("block")).drop("__nth", "__n", "__first", "__last")


def genome_coordinates(rows: DataFrame, seqlens: DataFrame, pad: int = 0) -> DataFrame:
    """``genome_pos`` on one line through all chromosomes, and ``chrom_frac`` within its own."""
    from popspark.operators.genmap import chrom_key

    w = W.orderBy(chrom_key(F.col("chrom"))).rowsBetween(W.unboundedPreceding, -1)
    offset = seqlens.withColumn("__offset", F.coalesce(F.sum(F.col("length") + pad).over(w), F.lit(0)))
    j = rows.join(offset, "chrom")
    return j.withColumns({"genome_pos": F.col("pos") + F.col("__offset"), "chrom_frac": F.col("pos") / F.col("length")}).drop("__offset", "length")


def standardise(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Ratio to the mean and z score (population deviation) of a column within groups."""
    w = W.partitionBy(*(by or ["chrom"]))
    mean, sd = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return rows.withColumns({"ratio": F.col(column) / mean, "z": (F.col(column) - mean) / F.nullif(sd, F.lit(0.0))})


def first_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each value of ``by``."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).filter("__n = 1").drop("__n")


def window_index(windows: DataFrame) -> DataFrame:
    """Number of each window in its chromosome and overall, in natural order of chromosomes.

    The overall number is the chromosome's offset, from one row for each chromosome, plus the number in it.
    """
    from popspark.operators.genmap import chrom_key

    sizes = windows.groupBy("chrom").agg(F.count("*").alias("n"))
    w = W.orderBy(chrom_key(F.col("chrom"))).rowsBetween(W.unboundedPreceding, -1)
    offset = sizes.select("chrom", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__offset"))
    r = scans.numbered(windows, ["chrom"], "bin", "index_in_chrom").withColumn("index_in_chrom", F.col("index_in_chrom").cast("int"))
    return r.join(offset, "chrom").withColumn("index", F.col("__offset") + F.col("index_in_chrom")).drop("__offset")


def python_aggregate(func):
    """A Python function of one or more arrays as an aggregate Column function, for ``window_agg`` and ``edge_agg``.

    Built-in aggregates combine partial results and are faster; this one sees a group's values whole.
    """

    def run(*columns):
        return float(func(*[c.to_numpy() for c in columns]))

    def one(x: pd.Series) -> float:
        return run(x)

    def two(x: pd.Series, y: pd.Series) -> float:
        return run(x, y)

    def call(*columns) -> Column:
        return F.pandas_udf(one if len(columns) == 1 else two, "double")(*columns)

    return call
