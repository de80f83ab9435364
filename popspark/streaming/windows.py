"""Windowed diversity over sites that arrive as files: the batch aggregation on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.operators.diversity import pair_counts

SITES = "chrom string, pos long, n_ref int, n_alt int"


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SITES).parquet(path)


def window_sums(sites: DataFrame, width: int) -> DataFrame:
    """Running sums of each window; state is a row for each window, bounded by the genome."""
    p = pair_counts(sites).groupBy("chrom", F.floor(F.col("pos") / width).cast("int").alias("bin"))
    return p.agg(F.sum("n_same").alias("n_same"), F.sum("n_diff").alias("n_diff"), F.count("*").alias("n_sites"))
