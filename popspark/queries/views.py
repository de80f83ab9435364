"""The genomic tables that the queries run on, derived from the driver tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.operators import genmap, intervals, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


class Views:
    """Lazy tables of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def chrom(key: str) -> Column:
        return F.concat(F.lit("chr"), (F.col(key) % 5 + 1).cast("string")).alias("chrom")

    @property
    def seqlens(self) -> DataFrame:
        o = self.raw("orders")
        per = o.groupBy(self.chrom("o_custkey")).agg(((F.max("o_orderkey") + 1) * 8).alias("length"))
        return per.withColumn("length", F.max("length").over(W.partitionBy()))  # a row for each chromosome

    @property
    def sites(self) -> DataFrame:
        return self.reads.groupBy("chrom", "pos").agg(*self.alleles)

    def sites_in(self, width: int) -> DataFrame:
        """``sites`` with their window ``bin`` and dealt by it: hardly any two rows are one site, so rows are shuffled once for sites and windows."""
        rows = ordered.spread(self.reads.withColumn("bin", F.floor(F.col("pos") / width).cast("int")), "chrom", "bin")
        return rows.groupBy("chrom", "bin", "pos").agg(*self.alleles)

    @property
    def reads(self) -> DataFrame:
        pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
        return self.raw("lineitem").select(self.chrom("l_suppkey"), pos, "l_quantity", "l_discount")

    @property
    def alleles(self) -> tuple[Column, Column]:
        return F.sum("l_quantity").cast("int").alias("n_ref"), F.sum(F.round(F.col("l_discount") * 100)).cast("int").alias("n_alt")

    @property
    def feats(self) -> DataFrame:
        start = F.col("o_orderkey") * 8
        end = start + 1 + (F.floor("o_totalprice") % 40)
        return self.raw("orders").select(self.chrom("o_custkey"), start.alias("start"), end.alias("end"), F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("status"))

    @property
    def neutral(self) -> DataFrame:
        return intervals.merge(self.feats.filter("status = 'F'"))

    @property
    def access(self) -> DataFrame:
        return intervals.complement(self.feats.filter("feature = '1-URGENT'"), self.seqlens)

    @property
    def hapmap(self) -> DataFrame:
        return self.raw("part").select(self.chrom("p_partkey"), (F.col("p_partkey") * 60).alias("pos"), (F.col("p_size") / 10).alias("rate"))

    @property
    def recmap(self) -> DataFrame:
        return genmap.recmap(self.hapmap, self.seqlens)

    @property
    def track(self) -> DataFrame:
        return self.raw("events").select(self.chrom("user_id"), (F.col("event_id") * 12).alias("start"), (F.col("event_id") * 12 + 1).alias("end"), F.col("value").alias("score"))


SQL = """
seqlens AS (SELECT DISTINCT 'chr' || (o_custkey % 5 + 1) AS chrom, (SELECT (max(o_orderkey) + 1) * 8 FROM orders) AS length FROM orders),
sites AS (SELECT 'chr' || (l_suppkey % 5 + 1) AS chrom, l_orderkey * 8 + l_linenumber AS pos, sum(l_quantity)::INT AS n_ref,
  sum(round(l_discount * 100))::INT AS n_alt FROM lineitem GROUP BY 1, 2),
feats AS (SELECT 'chr' || (o_custkey % 5 + 1) AS chrom, o_orderkey * 8 AS s, o_orderkey * 8 + 1 + (floor(o_totalprice)::BIGINT % 40) AS e,
  o_orderpriority AS feature, o_orderstatus AS status FROM orders),
hapmap AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 60 AS pos, p_size / 10.0::DOUBLE AS rate FROM part),
track AS (SELECT 'chr' || (user_id % 5 + 1) AS chrom, event_id * 12 AS s, event_id * 12 + 1 AS e, value AS score FROM events)
"""


def merged(name: str, source: str, by: str = "chrom", gap: int = 0) -> str:
    """CTEs for ``name`` (by, s, e): the merged intervals of ``source``."""
    return f"""{name}_1 AS (SELECT {by}, s, e, CASE WHEN s > max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS n FROM ({source}) WHERE e > s),
{name}_2 AS (SELECT {by}, s, e, sum(n) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {name}_1),
{name} AS (SELECT {by}, min(s) AS s, max(e) AS e FROM {name}_2 GROUP BY {by}, i)"""


def gaps(name: str, source: str) -> str:
    """CTEs for ``name`` (chrom, s, e): what merged intervals ``source`` leave of each chromosome."""
    return f"""{name} AS (SELECT chrom, s, e FROM (
  SELECT chrom, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s), 0) AS s, s AS e FROM {source}
  UNION ALL SELECT l.chrom, coalesce(max(m.e), 0), any_value(l.length) FROM seqlens l LEFT JOIN {source} m USING (chrom) GROUP BY l.chrom) WHERE e > s)"""


NEUTRAL = merged("neutral", "SELECT chrom, s, e FROM feats WHERE status = 'F'")
ACCESS = merged("urgent", "SELECT chrom, s, e FROM feats WHERE feature = '1-URGENT'") + ",\n" + gaps("access", "urgent")
RECMAP = """recmap_1 AS (SELECT chrom, pos AS s, coalesce(lead(pos) OVER (PARTITION BY chrom ORDER BY pos), length) AS e, rate * 1e-8 AS rate FROM hapmap JOIN seqlens USING (chrom)
  UNION ALL SELECT chrom, 0, min(pos), 0.0 FROM hapmap GROUP BY chrom HAVING min(pos) > 0),
recmap AS (SELECT chrom, s, e, rate, coalesce(sum((e - s) * rate) OVER (PARTITION BY chrom ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  sum((e - s) * rate) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS c1 FROM recmap_1 WHERE e > s)"""


def tiles(width: int) -> str:
    return f"""tiles AS (SELECT chrom, b AS bin, b * {width} AS s, least((b + 1) * {width}, length) AS e FROM seqlens, LATERAL unnest(range(0, (length + {width} - 1) // {width})) AS u(b))"""


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query; ``sql`` is its oracle over the views and ``ctes``."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = "WITH " + ",\n".join(x.strip() for x in (SQL, *ctes)) + "\n" + sql.strip()
        return f

    return register
