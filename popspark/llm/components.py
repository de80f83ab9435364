"""Connected components of a link table, distributed, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import parts_for, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least.hint("merge"), "a")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``links`` (a, b): the smallest id that can be reached.

    Each step maps every edge to the least neighbour of one end; sums are partial, so a node with very many links
    is no hot spot, and the joins are between written tables, whose hot partitions adaptive execution splits.
    Links of an id with itself are kept as an id of its own.
    """
    one = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    parts = parts_for(links.count())
    edges = stored(links.select(*one).distinct(), "edges", parts)
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = edges.filter("a <> b")
    now = _state(edges)
    while now[0]:
        # large star: greater neighbours of a node move to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", parts)
        large = stored(_star(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large", parts)
        # small star: a node and its lesser neighbours move to the least of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least", parts)
        small = _star(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.filter("a <> b").distinct(), "edges", parts)
        was, now = now, _state(edges)
        if was == now:
            break
    return ids.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")), "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
