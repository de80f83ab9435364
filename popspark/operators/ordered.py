"""A global order of rows over many tasks: range partitions, their counts, and offsets from these."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept by a checkpoint in the shared folder of ``spark.checkpoint.dir``.

    Only a local session may leave the folder unnamed.
    """
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.match(r"local($|\[)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        sc.setCheckpointDir(named)
    return rows.checkpoint()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` over all of a shuffle's tasks, for work that costs more than its bytes tell.

    Of tasks that Spark puts together by their bytes, one more than there are cores takes as long as two for each.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(rows: DataFrame, by: list[str], out: str = "nth", seed: int = 11) -> DataFrame:
    """``out``: the 0-based number of each row in the order of ``by`` (nulls first), over the whole table.

    Equal rows in ``by`` are in the order of a hash of all their columns, and equal in that too in any order, so one
    value may fill many range partitions.  The order is kept once; its offsets are one row for each partition.
    """
    tie = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns])
    r = rows.withColumns({"__tie": tie, "__salt": F.monotonically_increasing_id()})
    keys = [*[F.col(c).asc_nulls_first() for c in by], F.col("__tie"), F.col("__salt")]
    r = r.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie", "__salt")
    id_ = F.monotonically_increasing_id()
    r = kept(r.withColumns({"__part": F.shiftright(id_, 33), "__at": id_.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts, offset, before = r.groupBy("__part").count().orderBy("__part").collect(), [], 0
    for c in counts:
        offset.append((c["__part"], before))
        before += c["count"]
    few = rows.sparkSession.createDataFrame(offset, "__part long, __before long")  # a row for each partition
    return r.join(F.broadcast(few), "__part").withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def folds(rows: DataFrame, by: list[str], k: int, out: str = "fold") -> DataFrame:
    """``out``: contiguous folds 0 .. k - 1 of the order; the first n % k hold one row more."""
    r = numbered(rows, by, "__nth")
    n = r.count()
    small, more = divmod(n, k)
    first = (small + 1) * more
    nth = F.col("__nth")
    late = F.floor((nth - first) / max(1, small)) + more
    return r.withColumn(out, F.when(nth < first, F.floor(nth / (small + 1))).otherwise(late).cast("int")).drop("__nth")


def drawn(rows: DataFrame, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """As many rows as there are for each ``replicate``, drawn with replacement by their number.

    Draws are counted before they meet the rows, so a row is joined once and then repeated.
    """
    r = numbered(rows, by or rows.columns, "__nth")
    n = r.count()
    spark = rows.sparkSession
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "replicate", "draw"), 11).cast("double") * F.lit(2.0**-53)
    draws = spark.range(replicates * n).select((F.floor(F.col("id") / max(1, n)) + 1).alias("replicate"), (F.col("id") % max(1, n)).alias("draw"))
    times = draws.select("replicate", F.floor(u * n).cast("long").alias("__nth")).groupBy("replicate", "__nth").agg(F.count("*").cast("int").alias("__times"))
    return r.join(times, "__nth").select("replicate", *[f"`{c}`" for c in rows.columns], F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__copy")
