"""Recombination maps: rates on intervals, cumulative positions, lookups in both directions.

A map is (chrom, start, end, rate, cum_start, cum_end) with rates in Morgans per base pair and cumulative positions
in Morgans.  Lookups interpolate between the right ends of the intervals and are constant beyond the first and last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators import scans
from popspark.operators.rangejoin import BUCKET, interpolate

CM_PER_MB = 1e-8


def recmap(points: DataFrame, seqlens: DataFrame, factor: float = CM_PER_MB) -> DataFrame:
    """Map from markers (chrom, pos, rate): the rate of a marker holds up to the next, that of the last to the end.

    Before the first marker the rate is 0; a marker at the end of its chromosome adds nothing.
    """
    p = points.join(seqlens, "chrom")
    p = scans.following(p, ["chrom"], "pos", {"pos": "__end"})
    end = F.coalesce("__end", F.col("length"))
    rows = p.select("chrom", F.col("pos").alias("start"), end.alias("end"), (F.col("rate") * factor).alias("rate"))
    head = points.groupBy("chrom").agg(F.min("pos").alias("end")).join(seqlens.select("chrom"), "chrom", "left_semi")
    head = head.select("chrom", F.lit(0).cast("long").alias("start"), "end", F.lit(0.0).alias("rate"))
    return cumulative(rows.unionByName(head).filter(F.col("end") > F.col("start")))


def cumulative(rates: DataFrame) -> DataFrame:
    """Add running map positions to (chrom, start, end, rate)."""
    size = (F.col("end") - F.col("start")) * F.col("rate")
    return scans.running_sum(rates, ["chrom"], "start", size, "cum_start", "cum_end")


def marginal(points: DataFrame, seqlens: DataFrame | None = None) -> DataFrame:
    """Rates in cM/Mb between cumulative markers (chrom, pos, cum in cM); the last marker has none."""
    p = scans.following(points, ["chrom"], "pos", {"pos": "__pos", "cum": "__cum"})
    return p.withColumn("rate", (F.col("__cum") - F.col("cum")) / (F.col("__pos") - F.col("pos")) * 1e6).drop("__pos", "__cum")


def position(points: DataFrame, m: DataFrame, pos: str = "pos", out: str = "map_pos", bucket: int = BUCKET) -> DataFrame:
    """Cumulative map position of each point."""
    return interpolate(points, m.select("chrom", F.col("end").alias("x"), F.col("cum_end").alias("y")), pos=pos, out=out, bucket=bucket)


def rate_at(points: DataFrame, m: DataFrame, pos: str = "pos", out: str = "rate_at", bucket: int = BUCKET) -> DataFrame:
    """Rate between interval ends, linear."""
    return interpolate(points, m.select("chrom", F.col("end").alias("x"), F.col("rate").alias("y")), pos=pos, out=out, bucket=bucket)


def inverse(points: DataFrame, m: DataFrame, map_pos: str = "map_pos", out: str = "pos", scale: float = 1e-6) -> DataFrame:
    """Base position of each map position; of positions with one map position the first counts.

    ``scale``: map length, in Morgans, of a bucket of the range join.
    """
    knots = m.select("chrom", (F.col("cum_end") / scale).alias("x"), F.col("end").cast("double").alias("y"))
    p = points.withColumn("__at", F.col(map_pos) / scale)
    return interpolate(p, knots, pos="__at", out=out, bucket=1).drop("__at")


def window_rates(windows: DataFrame, m: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Mean rate of each window: difference of its ends' map positions over its width."""
    w = position(position(windows, m, "start", "__m0", bucket), m, "end", "__m1", bucket)
    return w.withColumn("rec_rate", (F.col("__m1") - F.col("__m0")) / (F.col("end") - F.col("start"))).drop("__m0", "__m1")


def lengths(m: DataFrame) -> DataFrame:
    """Map length of each chromosome and, with a null chrom, in all."""
    per = m.groupBy("chrom").agg(F.max("cum_end").alias("map_length"))
    return per.unionByName(per.agg(F.sum("map_length").alias("map_length")).select(F.lit(None).cast("string").alias("chrom"), "map_length"))


def trim_ends(m: DataFrame, cm: float, lower: str = "first") -> DataFrame:
    """(chrom, lower, upper) positions ``cm`` centimorgans from the map's ends.

    ``lower='first'`` is the least marker below the threshold, which trims to the first marker only; ``'last'`` the
    greatest.
    """
    total = m.groupBy("chrom").agg(F.max("cum_end").alias("total"))
    low = F.when(F.col("cum_end") < cm / 100, F.col("end"))
    high = F.when(F.col("cum_end") < F.col("total") - cm / 100, F.col("end"))
    pick = F.min(low) if lower == "first" else F.max(low)
    return m.join(total, "chrom").groupBy("chrom").agg(pick.alias("lower"), F.max(high).alias("upper"))


def clean(points: DataFrame, k: float | None = None) -> DataFrame:
    """Drop markers (chrom, pos, cum) that break monotony, then those whose following rate reaches ``k`` deviations."""
    up, down = scans.inside(["chrom"], "pos"), scans.inside(["chrom"], F.desc("pos"))
    p = scans.carried(scans.blocked(points, "pos"), ["chrom"], __before=(F.max("cum"), F.max, -1), __after=(F.min("cum"), F.min, 1))
    before = F.coalesce(F.greatest(F.max("cum").over(scans.earlier(up)), F.col("__before")), F.col("cum"))
    after = F.coalesce(F.least(F.min("cum").over(scans.earlier(down)), F.col("__after")), F.col("cum"))
    kept = p.withColumns({"__b": before, "__a": after}).filter("cum >= __b AND cum <= __a").select(*points.columns)
    if k is None:
        return kept
    rated = marginal(kept)
    sd = rated.groupBy("chrom").agg(F.stddev_pop("rate").alias("__sd"))  # a row for each chromosome
    return rated.join(sd, "chrom").filter(F.col("rate").isNull() | (F.col("rate") < k * F.col("__sd"))).select(*points.columns)


def sorted_check(points: DataFrame, pos: str = "pos", order: str = "pos") -> DataFrame:
    """(chrom, is_sorted): whether ``pos`` never falls along ``order``."""
    one = F.struct(F.col(order).alias("at"), F.col(pos).alias("pos"))
    p = scans.carried(scans.blocked(points, order), ["chrom"], __last=(F.max(one), F.max, -1))
    before = F.coalesce(F.lag(one).over(scans.inside(["chrom"], order)), F.col("__last"))
    return p.withColumn("__f", F.coalesce(before["pos"] > F.col(pos), F.lit(False))).groupBy("chrom").agg((~F.max("__f")).alias("is_sorted"))


def chrom_key(chrom):
    """Sort key of natural order: numbers first, then X, Y, M, then other names."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = F.regexp_extract(bare, r"^(\d+)$", 1)
    rank = F.when(number != "", F.lit(0)).when(bare == "X", 1).when(bare == "Y", 2).when(bare.isin("M", "MT"), 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.coalesce(F.when(number != "", number).cast("long"), F.lit(0)).alias("number"), bare.alias("name"))
