"""From sites to windows: masked diversity, flags, and the table of window statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators import diversity as D
from popspark.operators import genmap, intervals
from popspark.operators.rangejoin import BUCKET, overlaps


def windowed_pi(sites: DataFrame, neutral: DataFrame, accessible: DataFrame, seqlens: DataFrame, width: int, outliers: tuple[float, float] | None = None, combine: str = "replace", bucket: int = BUCKET) -> DataFrame:
    """Diversity of every window from neutral accessible sites, with a keep flag.

    The flag says whether enough of the window is accessible; with ``outliers`` quantiles of pi over the windows
    flagged so far decide, in place of the earlier flag or in addition to it.
    """
    windows = intervals.tile(seqlens, width)
    masked = D.mask_sites(sites, neutral, accessible, bucket)
    w = D.flag_accessible(D.window_pairs(masked, windows, width), accessible)
    return D.flag_outliers(w, *outliers, combine) if outliers else w


def window_table(sites: DataFrame, features: DataFrame, recmap: DataFrame, seqlens: DataFrame, width: int) -> DataFrame:
    """One row for each window and feature: bases, mean recombination rate and pi."""
    windows = intervals.tile(seqlens, width)
    pi = D.window_pairs(sites, windows, width).select("chrom", "bin", "pi")
    rates = genmap.window_rates(windows, recmap)
    names = features.select("feature").distinct()
    bases = overlaps(windows, features).groupBy("chrom", "bin", "feature").agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))
    grid = rates.join(pi, ["chrom", "bin"]).crossJoin(F.broadcast(names))
    return grid.join(bases, ["chrom", "bin", "feature"], "left").fillna(0, ["bases"])


def trimmed_sites(sites: DataFrame, recmap: DataFrame, cm: float = 0.1, lower: str = "first") -> DataFrame:
    """Sites strictly between the trimmed ends of each chromosome's map."""
    ends = genmap.trim_ends(recmap, cm, lower)
    return sites.join(F.broadcast(ends), "chrom").filter((F.col("pos") > F.coalesce("lower", F.lit(-1))) & (F.col("pos") < F.col("upper"))).drop("lower", "upper")
