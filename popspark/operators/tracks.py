"""Score tracks, label tables and small row operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.operators import quantiles as Q


def bin_track(track: DataFrame, width: int, how: str = "mean") -> DataFrame:
    """(chrom, start, end, value): mean (weighted by bases) or max of a track's scores in bins; bins without scores are absent."""
    at = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("__b")
    t = track.filter(F.col("score").isNotNull() & ~F.isnan("score")).select("chrom", "start", "end", "score", at)
    size = F.least(F.col("end"), (F.col("__b") + 1) * width) - F.greatest(F.col("start"), F.col("__b") * width)
    value = F.max("score") if how == "max" else F.sum(F.col("score") * size) / F.sum(size)
    out = t.groupBy("chrom", "__b").agg(value.alias("value"))
    return out.select("chrom", (F.col("__b") * width).alias("start"), ((F.col("__b") + 1) * width).alias("end"), "value")


def quantiles(rows: DataFrame, column: str, probs: list[float], exact: bool = True) -> DataFrame:
    """One row with an array ``q``; ``exact=False`` is one pass less."""
    if not exact:
        return rows.agg(F.percentile_approx(column, probs, 10000).alias("q"))
    return rows.sparkSession.createDataFrame([(Q.exact(rows, column, probs),)], "q array<double>")


def quantile_classes(cells: DataFrame, probs: list[float], column: str = "value", exact: bool = True) -> DataFrame:
    """Class 1, 2, ... of each cell by the quantiles of its value."""
    q = quantiles(cells, column, probs, exact)
    over = reduce(lambda a, b: a + b, [(F.col(column) > F.col("q")[k]).cast("int") for k in range(len(probs))])
    return cells.crossJoin(F.broadcast(q)).withColumn("class", over + 1).drop("q")


def censor(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two quantiles of a column, both included."""
    lower, upper = Q.exact(rows, column, [low, high])
    return rows.filter(F.col(column).between(F.lit(lower), F.lit(upper)))


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in columns]
    return rows.filter(reduce(lambda a, b: a & b, ok))


def bound(rows: DataFrame, column: str, most: float) -> DataFrame:
    """``column`` at most ``most``, with a flag for rows that were above."""
    return rows.withColumn("clipped", F.col(column) > most).withColumn(column, F.least(F.col(column), F.lit(most)))


def feature_index(*tables: DataFrame) -> DataFrame:
    """Distinct features of all tables with running numbers."""
    names = reduce(DataFrame.union, [t.select("feature") for t in tables]).distinct()
    return names.withColumn("feature_id", F.dense_rank().over(W.orderBy("feature")) - 1)


def nearest(rows: DataFrame, column: str, grid: list[float], out: str = "nearest") -> DataFrame:
    """The grid value next to a column's value; of two the first."""
    values = F.array(*[F.lit(float(g)) for g in grid])
    best = F.array_min(F.transform(values, lambda g, i: F.struct(F.abs(g - F.col(column)).alias("d"), i.alias("i"), g.alias("g"))))
    return rows.withColumn(out, best["g"])


def exact_index(rows: DataFrame, column: str, grid: list[float], tolerance: float) -> DataFrame:
    """Rows whose value is within ``tolerance`` of exactly one grid value, with its number."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("g")) for i, g in enumerate(grid)])
    hits = F.filter(values, lambda s: F.abs(s["g"] - F.col(column)) <= tolerance)
    return rows.withColumn("__h", hits).filter(F.size("__h") == 1).withColumn("grid_id", F.col("__h")[0]["i"]).drop("__h")


def smallest_mapped(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """For each mapped gene the transcript with the least number, and how many there are."""
    j = pairs.join(known, "gene", "left_semi")
    return j.groupBy("gene").agg(F.min_by("transcript", F.col("transcript").cast("long")).alias("transcript"), F.count("*").alias("transcripts"))


def map_slice(segments: DataFrame, chrom: str, map_pos: float, distance: float) -> DataFrame:
    """Segments of a chromosome within ``distance`` Morgans of a map position."""
    near = (F.col("map_start") <= map_pos + distance) & (F.col("map_end") >= map_pos - distance)
    return segments.filter((F.col("chrom") == chrom) & near)


def masked_runs(chunks: DataFrame, letters: str = "Nnatcg", merge_chunks: bool = True) -> DataFrame:
    """Ranges of masked bases of sequence chunks (chrom, chunk_start, seq); runs over a chunk border are joined."""
    found = F.regexp_extract_all("seq", F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))
    parts = chunks.select("chrom", "chunk_start", F.posexplode(found).alias("k", "run"))
    w = W.partitionBy("chrom", "chunk_start").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("run")
    placed = parts.withColumn("start", F.col("chunk_start") + F.coalesce(F.sum(size).over(w), F.lit(0)))
    out = placed.filter(F.col("run").rlike(f"^[{letters}]")).select("chrom", "start", (F.col("start") + size).alias("end"))
    if not merge_chunks:
        return out
    from popspark.operators.intervals import merge

    return merge(out)


def segment_gc(segments: DataFrame, chunks: DataFrame, bucket: int = 4096) -> DataFrame:
    """GC fraction of each segment from chunks (chrom, chunk_start, seq); N does not count."""
    from popspark.operators.rangejoin import overlaps

    c = chunks.select("chrom", F.col("chunk_start").alias("start"), (F.col("chunk_start") + F.length("seq")).alias("end"), "seq")
    hit = overlaps(segments, c, bucket)
    part = F.substring("seq", F.col("lo") - F.col("b_start") + 1, F.col("hi") - F.col("lo"))
    count = lambda letters: F.length(part) - F.length(F.translate(part, letters, ""))
    return hit.groupBy(*segments.columns).agg((F.sum(count("GCgc")) / F.nullif(F.sum(count("ACGTacgt")), F.lit(0))).alias("gc"))


def merge_parts(*parts: DataFrame) -> DataFrame:
    """Rows of tables made for different chromosomes; a chromosome in two of them is an error."""
    named = [p.select("chrom").distinct().withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    twice = reduce(DataFrame.unionByName, named).groupBy("chrom").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("a chromosome occurs in more than one part")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
