"""Writers.  Each writes a folder of part files; ``gzip`` and append follow Spark's options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.operators.genmap import chrom_key, marginal


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartitionByRange(chrom_key(F.col("chrom")), *keys).sortWithinPartitions(chrom_key(F.col("chrom")), *keys)


def write_bed(rows: DataFrame, path: str, compress: bool = True, append: bool = False) -> None:
    r = _sorted(rows.select("chrom", "start", "end", *[c for c in rows.columns if c not in ("chrom", "start", "end")]), "start", "end")
    r.write.csv(path, sep="\t", compression="gzip" if compress else "none", mode="append" if append else "overwrite")


def write_counts(sites: DataFrame, path: str, params: dict[str, str]) -> None:
    """Counts (chrom, pos, n_total, n_derived) and, in a part file of its own, the header line."""
    s = sites.select("chrom", "pos", (F.col("n_ref") + F.col("n_alt")).alias("n_total"), F.col("n_alt").alias("n_derived"))
    _sorted(s, "pos").write.csv(path, sep="\t", mode="overwrite")
    head = "#" + ";".join(f"{k}={v}" for k, v in params.items())
    sites.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(path)


def write_hapmap(points: DataFrame, path: str) -> None:
    """Cumulative markers (chrom, pos, cum) as chrom, pos, rate, cum."""
    m = marginal(points).select("chrom", "pos", F.coalesce("rate", F.lit(0.0)).alias("rate"), "cum")
    _sorted(m, "pos").write.csv(path, sep="\t", header=True, mode="overwrite")


def write_marker_bed(points: DataFrame, path: str) -> None:
    b = points.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "cum")
    write_bed(b, path, compress=False)


def write_window_table(rows: DataFrame, path: str) -> None:
    _sorted(rows, "start", "end").write.csv(path, sep="\t", header=True, mode="overwrite")


def write_predictions(rows: DataFrame, path: str, by_feature: bool = False) -> None:
    w = _sorted(rows, "start", "end").write.mode("overwrite")
    (w.partitionBy("feature") if by_feature else w).csv(path, sep="\t", header=True)


def weight_lines(theta: DataFrame, digits: int = 3) -> DataFrame:
    """(feature, weights): the weights of a feature in order of t, joined by commas."""
    w = F.array_sort(F.collect_list(F.struct("ti", F.round("weight", digits).cast("string").alias("w"))))
    return theta.groupBy("feature").agg(F.array_join(F.transform(w, lambda x: x["w"]), ",").alias("weights"))


def write_weights(theta: DataFrame, path: str, digits: int = 3) -> None:
    weight_lines(theta, digits).coalesce(1).write.csv(path, sep="\t", mode="overwrite")


def write_bundle(path: str, **tables: DataFrame) -> None:
    """Tables of a fit (windows, slopes, grids ...) as Parquet under one folder."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_by_chromosome(rows: DataFrame, path: str) -> None:
    rows.repartition("chrom", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(8))).write.mode("overwrite").partitionBy("chrom").parquet(path)
