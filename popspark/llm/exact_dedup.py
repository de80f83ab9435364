"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest that lives on in its folder: any session can open it by path.  New
data is reduced to one row for each digest before it meets the index, so no digest is hot there; the index side of
the sort-merge anti-join needs no shuffle.  New digests are appended.  Rows learn their group from a second sort-merge
join whose two sides are plain scans: adaptive execution splits the partition of a digest that holds a large part of
all rows.

Defined results: a null text counts as empty; empty texts are equal to each other; null doc_ids sort after all others
(a group of only null ids keeps null); rows that repeat a doc_id each get a row, and of equal texts exactly one row is
kept, also where rows share the least doc_id; an empty table gives an empty result; ``keep_first`` leaves all columns
of the rows that stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import SPACES, documents, scratch_path, stored, unused


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text: F.Column) -> F.Column:
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """Digests seen so far with the document that stays for each, as a bucketed table in the folder ``path``.

    A folder that holds an index is opened as it is, with the number of buckets it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 32):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or scratch_path(spark, "digest-index")).rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/buckets").first()["buckets"]
        except AnalysisException:  # no index there yet
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}/buckets")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Those of ``groups``, one row for each digest, that the index does not hold."""
        return groups.join(self.table().hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame) -> DataFrame:
        """Append the digests of ``groups`` (digest, keep_id, ...) that the index does not hold; returns their rows."""
        fresh = stored(self.unknown(groups), "fresh")  # a table cannot be read and appended to in one go
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as Spark numbers them: one file for each, however many tasks write
        fresh.select("digest", "keep_id").repartition(bucket).write.insertInto(self.name)
        return fresh


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"))


def _numbered(rows: DataFrame, batches: int) -> DataFrame:
    """``rows`` with a number for each (where they have none), settled once they are written, and ``batch``: ranges of doc_id of about one size, null last."""
    cuts = rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else None
    batch = reduce(lambda a, c: a + F.coalesce((F.col("doc_id") > c).cast("int"), F.lit(1)), cuts or [], F.lit(0))
    rows = rows if "row" in rows.columns else rows.withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("batch", batch)


def _verdict(rows: DataFrame, index: DigestIndex, batches: int) -> DataFrame:
    """One row for each digest of ``rows`` (doc_id, digest, row, batch): keep_id, group_size, and the row that stays, if one of these does."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least")
    fresh = []
    for k in range(batches):
        groups = rows.filter(F.col("batch") == k).groupBy("digest").agg(least)
        fresh.append(index.add(groups.select("digest", F.col("least.doc_id").alias("keep_id"), F.col("least.row").alias("keep_row"))))
    stays = reduce(DataFrame.unionByName, fresh).select("digest", "keep_row")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    return stored(sizes.join(index.table().hint("merge"), "digest").join(stays.hint("merge"), "digest", "left"), "known")


def deduplicate(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size (among ``docs``), kept, text_sha256.

    ``docs`` enter the index in ``batches`` ranges of rising doc_id.  A digest that the index holds already keeps
    the document that brought it in.
    """
    rows = stored(_numbered(digests(docs), batches), "digests")
    known = _verdict(rows, index, batches)
    return rows.join(known.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex, batches: int = 1) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    row = unused(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keys = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.col(row).alias("row"))
    stays = _verdict(stored(_numbered(keys, batches), "digests"), index, batches).select(F.col("keep_row").alias(row))
    return rows.join(stays.filter(F.col(row).isNotNull()).hint("merge"), row, "left_semi").drop(row)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, so that the second one meets the digests of the first."""
    return deduplicate(documents(spark, sf_dir), DigestIndex(spark), batches=2)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
