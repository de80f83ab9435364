"""Exact quantiles without all values in one task.

A sketch brackets the ranks around each quantile, one pass counts what lies below a bracket and how often each value
inside occurs, and the exact ranks are found among these values alone.  Where a bracket may hold more than ``MOST``
distinct values, it is bracketed again first.  Quantiles interpolate linearly between the two ranks around p * (n - 1), as the
built-in exact ``percentile`` does; nulls are not counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the sketch (its rank error is n / ACCURACY), and distinct values that may meet in one task.
ACCURACY, MOST = 10_000, 1_000_000


def _around(p: float, slack: float) -> tuple[float, float]:
    return max(0.0, p - slack), min(1.0, p + slack)


def _sketch(rows: DataFrame, probs: list[float], accuracy: int) -> list[float]:
    return rows.agg(F.percentile_approx("x", F.array(*[F.lit(p) for p in probs]), F.lit(accuracy)).alias("q")).first()["q"]


def _total(rows: DataFrame, tests: list) -> list[int]:
    """Counts of rows that pass each test, in one aggregation."""
    return list(rows.agg(*[F.count(F.when(t, F.lit(1))).alias(f"c{i}") for i, t in enumerate(tests)]).first())


def _ranks(p: float, n: int) -> tuple[int, int, float]:
    at = p * (n - 1)
    low = int(at)
    return low, min(low + 1, n - 1) if at > low else low, at


def exact(rows: DataFrame, column: str, probs: list[float], accuracy: int = ACCURACY, most: int = MOST) -> list[float | None]:
    """The quantiles ``probs`` of a numeric column, exact; None for each of a column without values."""
    x = rows.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
        if not n:
            return [None] * len(probs)
        wanted = [_ranks(p, n) for p in probs]
        slack = 2 / accuracy + 1 / n
        # a bracket is (lo, hi, rows below lo, rows inside)
        brackets: list[tuple] = [(low, high, 0, n)] * len(probs)
        for _ in range(8):
            wide = [k for k, b in enumerate(brackets) if b[3] > most and b[0] < b[1]]
            if not wide:
                break
            whole = {brackets[k] for k in wide} == {(low, high, 0, n)}
            if whole:  # one sketch serves all
                ends = _sketch(x, [e for k in wide for e in _around(probs[k], slack)], accuracy)
                found = {k: (ends[2 * i], ends[2 * i + 1]) for i, k in enumerate(wide)}
            else:
                found = {}
                for k in wide:
                    lo, hi, below, size = brackets[k]
                    first, last, _ = wanted[k]
                    ends = _around((first - below) / size, slack)[0], _around((last + 1 - below) / size, slack)[1]
                    found[k] = tuple(_sketch(x.filter(F.col("x").between(lo, hi)), list(ends), accuracy))
            counts = _total(x, [t for k in wide for t in (F.col("x") < found[k][0], F.col("x").between(*found[k]))])
            moved = False
            for i, k in enumerate(wide):
                below, size = counts[2 * i], counts[2 * i + 1]
                first, last, _ = wanted[k]
                if below <= first and last < below + size and size < brackets[k][3]:  # else the wider one stays
                    brackets[k], moved = (*found[k], below, size), True
            if not moved:
                slack *= 4
        return _read(x, brackets, wanted)
    finally:
        x.unpersist()


def _read(x: DataFrame, brackets: list[tuple], wanted: list[tuple]) -> list[float]:
    """Values at the wanted ranks, from how often each value of a bracket occurs; brackets that are equal are read once."""
    distinct = sorted(set(brackets))
    one = [F.when(F.col("x").between(b[0], b[1]), F.lit(i)) for i, b in enumerate(distinct)]
    any_ = reduce(lambda a, b: a | b, [F.col("x").between(b[0], b[1]) for b in distinct])
    often = x.filter(any_).groupBy("x").agg(F.count("*").alias("n"))  # partial sums: a value counts once for each task
    often = often.withColumn("k", F.explode(F.array_compact(F.array(*one))))
    below = F.element_at(F.array(*[F.lit(b[2]) for b in distinct]), F.col("k") + 1)
    upto = below + F.sum("n").over(W.partitionBy("k").orderBy("x"))
    asked = sorted({(distinct.index(b), r) for b, (first, last, _) in zip(brackets, wanted) for r in (first, last)})
    ranks = F.array(*[F.struct(F.lit(k).alias("of"), F.lit(r).alias("r")) for k, r in asked])
    hit = F.filter(ranks, lambda a: (a["of"] == F.col("k")) & (a["r"] < F.col("upto")) & (a["r"] >= F.col("upto") - F.col("n")))
    got = often.withColumn("upto", upto).withColumn("hit", F.explode(hit)).select("k", "hit.r", "x").collect()
    value = {(g["k"], g["r"]): g["x"] for g in got}
    out = []
    for b, (first, last, at) in zip(brackets, wanted):
        u, v = value[distinct.index(b), first], value[distinct.index(b), last]
        out.append(u if first == last else (last - at) * u + (at - first) * v)
    return out


def grouped(rows: DataFrame, by: list[str], column: str, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(by, q): exact quantiles of each group, where one group may hold most rows.

    The brackets of all groups are one row each and meet the rows by a join; a group's values inside its brackets are
    few next to its rows.
    """
    x = rows.select(*by, F.col(column).cast("double").alias("__x")).filter("__x IS NOT NULL")
    slack = 2 / accuracy
    ends = [e for p in probs for e in _around(p, slack)]
    per = x.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("__e"), F.min("__x").alias("__min"), F.max("__x").alias("__max"))

    def bracket(k: int):
        # one rank more to each side than the sketch may err: groups smaller than the accuracy have exact sketches
        p = probs[k]
        lo = F.col("__min") if p - slack <= 0 else F.col("__e")[2 * k]
        hi = F.col("__max") if p + slack >= 1 else F.col("__e")[2 * k + 1]
        at = F.lit(float(p)) * (F.col("__n") - 1)
        small = F.col("__n") <= accuracy  # then the bracket is the group
        return F.struct(F.when(small, F.col("__min")).otherwise(lo).alias("lo"), F.when(small, F.col("__max")).otherwise(hi).alias("hi"), F.floor(at).alias("first"), F.ceil(at).alias("last"), at.alias("at"))

    per = per.select(*by, F.array(*[bracket(k) for k in range(len(probs))]).alias("__k"))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    j = x.alias("x").join(per.alias("b"), same).select("x.*", "b.__k")
    each = j.select(*by, "__x", F.posexplode("__k").alias("__i", "__b")).filter(F.col("__x") <= F.col("__b.hi"))
    lower = F.col("__x") < F.col("__b.lo")
    often = each.groupBy(*by, "__i", "__b", F.when(~lower, F.col("__x")).alias("__v")).agg(F.count("*").alias("__n"))  # null: how many lie below
    upto = F.sum("__n").over(W.partitionBy(*by, "__i").orderBy(F.col("__v").asc_nulls_first()))
    often = often.withColumn("__upto", upto)
    at = lambda c: F.max(F.when((F.col(f"__b.{c}") < F.col("__upto")) & (F.col(f"__b.{c}") >= F.col("__upto") - F.col("__n")) & F.col("__v").isNotNull(), F.col("__v")))
    one = often.groupBy(*by, "__i", "__b").agg(at("first").alias("u"), at("last").alias("v"))
    b = F.col("__b")
    value = F.when(b["first"] == b["last"], F.col("u")).otherwise((b["last"] - b["at"]) * F.col("u") + (b["at"] - b["first"]) * F.col("v"))
    value = F.when(F.col("u").isNull() | F.col("v").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(value)
    q = F.transform(F.array_sort(F.collect_list(F.struct("__i", value.alias("value")))), lambda s: s["value"])
    return one.groupBy(*by).agg(q.alias("q"))
