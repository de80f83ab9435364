"""Predicted substitution rates and fitness variances of segments under fitted weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.plans.bmap import solve_ratchet


def substitution_table(segments: DataFrame, theta: DataFrame, t: list[float], n: float) -> DataFrame:
    """Each segment's R_seg = sum over t of 1/T at mutation rate mu * weight, r = R_seg / length (each part at most mu *
    weight), V, Vm and load; ``clipped`` counts the parts that were cut."""
    scale = F.col("n_scale") if "n_scale" in segments.columns else F.lit(1.0)
    s = segments.withColumns({"length": F.col("end") - F.col("start"), "n_scale": scale})
    cells = s.select("length", "rate", "n_scale", "feature").distinct().join(F.broadcast(theta.select("ti", "feature", (F.col("mu") * F.col("weight")).alias("muw"))), "feature")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            sh = np.array(t)[p["ti"].to_numpy()]
            x, v, vm = solve_ratchet(np.maximum(p["muw"].to_numpy(), 1e-300), sh, p["length"].to_numpy(), p["rate"].to_numpy(), n * p["n_scale"].to_numpy())
            rate = np.where(p["muw"] > 0, 1 / x, 0.0)
            most = p["muw"].to_numpy() * p["length"].to_numpy()
            cut = rate > most
            rate = np.minimum(rate, most)
            yield p.assign(R_seg=rate, V=np.where(p["muw"] > 0, v, 0.0), Vm=np.where(p["muw"] > 0, vm, 0.0), load=np.log1p(-2 * sh) * rate, clipped=cut.astype(int))

    keys = ["length", "rate", "n_scale", "feature"]
    solved = cells.mapInPandas(run, "feature string, length long, rate double, n_scale double, ti int, muw double, R_seg double, V double, Vm double, load double, clipped int")
    sums = solved.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("R_seg", "V", "Vm", "load", "clipped")])
    return s.join(sums, keys).withColumn("r", F.col("R_seg") / F.col("length"))


def feature_summary(predictions: DataFrame, mu: float) -> DataFrame:
    """By feature: mean and length-weighted r, r against mu in percent, sums of R_seg, V, Vm and load."""
    size = F.col("end") - F.col("start")
    return predictions.groupBy("feature").agg(
        F.avg("r").alias("r"), (F.sum(F.col("r") * size) / F.sum(size)).alias("r_weighted"), (F.avg("r") / mu * 100).alias("r_mu"),
        *[F.sum(c).alias(c) for c in ("R_seg", "V", "Vm", "load")],
    )


def window_rates(predictions: DataFrame, width: int) -> DataFrame:
    """Mean r of the segments whose midpoints lie in each window."""
    mid = (F.col("start") + F.col("end")) / 2
    return predictions.groupBy("chrom", F.floor(mid / width).cast("int").alias("bin")).agg(F.avg("r").alias("r"), F.count("*").alias("n"))
