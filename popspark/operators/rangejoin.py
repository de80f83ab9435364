"""Joins between positions and intervals.

A bare range predicate plans as a nested loop.  Here intervals are exploded over the fixed-width buckets they
cross, so the join has an equality key (chromosome, bucket) and the predicate is only checked inside a bucket.
Results do not depend on the bucket width; about the usual interval length is fastest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.operators import scans

BUCKET = 4096


def _floor(x: Column, bucket: int) -> Column:
    return F.floor(x / F.lit(bucket)).cast("long")


def bucketed(ranges: DataFrame, bucket: int = BUCKET, start: str = "start", end: str = "end") -> DataFrame:
    """One row of each interval for each bucket it crosses; empty intervals vanish."""
    ranges = ranges.filter(F.col(end) > F.col(start))
    last = F.col(end) if ranges.schema[end].dataType.typeName() == "double" else F.col(end) - 1
    return ranges.withColumn("__bucket", F.explode(F.sequence(_floor(F.col(start), bucket), _floor(last, bucket))))


def within(points: DataFrame, ranges: DataFrame, how: str = "left_semi", bucket: int = BUCKET, on=("chrom",), pos: str = "pos") -> DataFrame:
    """Points joined with the intervals [start, end) that hold them; ``left_semi`` never repeats a point."""
    on = list(on)
    p = points.withColumn("__bucket", _floor(F.col(pos), bucket)).alias("p")
    r = bucketed(ranges, bucket).alias("r")
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in [*on, "__bucket"]]
    inside = (F.col(f"p.{pos}") >= F.col("r.start")) & (F.col(f"p.{pos}") < F.col("r.end"))
    joined = p.join(r, [*same, inside], how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bucket")
    clash = set(points.columns)
    return joined.select("p.*", *[F.col(f"r.{c}").alias(f"r_{c}" if c in clash else c) for c in ranges.columns if c not in on]).drop("__bucket")


def inside_all(points: DataFrame, masks: list[DataFrame], bucket: int = BUCKET, on=("chrom",), pos: str = "pos") -> DataFrame:
    """Points inside an interval of every mask; they are shuffled once, by one bucket, for all of them."""
    p = points.withColumn("__bucket", _floor(F.col(pos), bucket))
    for mask in masks:
        same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in [*on, "__bucket"]]
        inside = (F.col(f"p.{pos}") >= F.col("r.start")) & (F.col(f"p.{pos}") < F.col("r.end"))
        p = p.alias("p").join(bucketed(mask, bucket).alias("r"), [*same, inside], "left_semi")
    return p.drop("__bucket")


def overlaps(a: DataFrame, b: DataFrame, bucket: int = BUCKET, on=("chrom",)) -> DataFrame:
    """All overlapping pairs: columns of ``a``, of ``b`` (prefixed ``b_`` where names clash), and the common part lo, hi.

    A pair is kept only in the bucket of the later start, so it comes once.
    """
    on = list(on)
    x, y = bucketed(a, bucket).alias("x"), bucketed(b, bucket).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*on, "__bucket"]]
    meet = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    lo, hi = F.greatest("x.start", "y.start"), F.least("x.end", "y.end")
    clash = set(a.columns)
    other = [F.col(f"y.{c}").alias(f"b_{c}" if c in clash else c) for c in b.columns if c not in on]
    joined = x.join(y, [*same, meet, F.col("x.__bucket") == _floor(lo, bucket)])
    return joined.select(*[F.col(f"x.{c}") for c in a.columns], *other, lo.alias("lo"), hi.alias("hi"))


def interpolate(points: DataFrame, knots: DataFrame, on=("chrom",), pos: str = "pos", x: str = "x", y: str = "y", out: str = "value", bucket: int = BUCKET) -> DataFrame:
    """``points`` with the value at ``pos`` of the piecewise linear curve through ``knots``, constant beyond its ends.

    Of knots with one x the least y counts.  Points without knots for their key get null.
    """
    on = list(on)
    k = knots.groupBy(*on, F.col(x).alias("x")).agg(F.min(y).alias("y"))
    spans = scans.following(k, on, "x", {"x": "end", "y": "y1"}).withColumnsRenamed({"x": "start", "y": "y0"}).filter(F.col("end").isNotNull())
    ends = k.groupBy(*on).agg(F.min("x").alias("__x0"), F.min_by("y", "x").alias("__y0"), F.max("x").alias("__x1"), F.max_by("y", "x").alias("__y1"))
    names = points.columns
    found = within(points, spans.withColumnsRenamed({"y0": "__ya", "y1": "__yb"}), "left", bucket, on, pos)
    start, end = (("r_start", "r_end") if "start" in names else ("start", "end"))
    at = F.col(pos)
    line = F.col("__ya") + (at - F.col(start)) * ((F.col("__yb") - F.col("__ya")) / (F.col(end) - F.col(start)))
    value = F.when(at <= F.col("__x0"), F.col("__y0")).when(at >= F.col("__x1"), F.col("__y1")).otherwise(line)
    return found.join(ends, on, "left").select(*names, value.alias(out))
