"""Scans along an integer axis (base positions, bin numbers) in blocks with carries.

A window over a whole chromosome is one task, however long the chromosome.  Here an axis is cut into blocks of fixed width: a window
sees one block, each block leaves one carry row, and a window over the carries, a row for each block, gives every block
what came before or comes after it.  Results do not depend on the width.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.operators.ordered import kept

#: Bases of a block, and rows of a block of a numbered series.
BLOCK, ROWS = 1 << 22, 1 << 16
#: A plan that reads its tables more often is computed and kept before it is used twice more, else plans would double with every scan.
LEAVES = 16
#: A table that Spark estimates to be no larger than so many bytes is one block, and needs no carries.
SMALL = 64_000_000

Carry = tuple[Column, Callable[[Column], Column], int]


def block_of(position: str | Column, width: int | None = None) -> Column:
    at = F.col(position) if isinstance(position, str) else position
    return F.floor(at / F.lit(width or BLOCK)).cast("long")


def _small(rows: DataFrame) -> bool:
    plan = rows._jdf.queryExecution()
    if plan.analyzed().collectLeaves().size() > 4:
        return False
    try:
        return plan.optimizedPlan().stats().sizeInBytes() <= SMALL
    except ValueError:  # an estimate over joins is a product, and may have more digits than Python reads
        return False


def blocked(rows: DataFrame, position: str | Column, width: int | None = None) -> DataFrame:
    """``rows`` with ``__block``; a column ``__whole`` marks a small table that is one block."""
    if _small(rows):
        return rows.withColumns({"__block": F.lit(0).cast("long"), "__whole": F.lit(True)})
    return rows.withColumn("__block", block_of(position, width))


def carried(rows: DataFrame, by: list[str], **carries: Carry) -> DataFrame:
    """``rows`` (with ``__block``) with a column for each carry (aggregate of a block, fold over blocks, side).

    Side -1 folds all earlier blocks of ``by``, 1 all later ones; where there is none the column is null.
    """
    if "__whole" in rows.columns:
        kinds = rows.agg(*[agg.alias(name) for name, (agg, _, _) in carries.items()]).schema
        return rows.withColumns({k.name: F.lit(None).cast(k.dataType) for k in kinds})
    if rows._jdf.queryExecution().analyzed().collectLeaves().size() > LEAVES:
        rows = kept(rows)
    # what comes after is what comes before in descending order: a frame to the end is summed anew for every row
    side = {-1: earlier(W.partitionBy(*by).orderBy("__block")), 1: earlier(W.partitionBy(*by).orderBy(F.desc("__block")))}
    per = rows.groupBy(*by, "__block").agg(*[agg.alias(name) for name, (agg, _, _) in carries.items()])
    per = per.select(*by, "__block", *[fold(F.col(name)).over(side[k]).alias(name) for name, (_, fold, k) in carries.items()])
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*by, "__block")]
    return rows.alias("x").join(per.alias("c"), reduce(lambda a, b: a & b, same)).select("x.*", *[f"c.{name}" for name in carries])


def inside(by: list[str], *order: str | Column):
    """The window over one block."""
    return W.partitionBy(*by, "__block").orderBy(*order)


def until(w):
    return w.rowsBetween(W.unboundedPreceding, 0)


def earlier(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def begun(rows: DataFrame, by: list[str], new: Column, at: str, out: str, *order: str) -> DataFrame:
    """``out``: the greatest ``at`` of a row with ``new`` up to this row, which names the group that the row is in."""
    mark = F.when(new, F.col(at))
    r = rows.withColumn("__mark", mark)
    r = r.withColumn("__own", F.max("__mark").over(until(inside(by, *order))))
    r = carried(r, by, __before=(F.max("__mark"), F.max, -1))
    return r.withColumn(out, F.coalesce("__own", "__before")).drop("__mark", "__own", "__before")


def numbered(rows: DataFrame, by: list[str], order: str, out: str, width: int | None = None) -> DataFrame:
    """``out``: the 0-based number of each row of ``by`` along ``order``, an integer."""
    r = carried(blocked(rows, order, width or ROWS), by, __count=(F.count(F.lit(1)), F.sum, -1))
    nth = F.row_number().over(inside(by, order)) - 1 + F.coalesce("__count", F.lit(0))
    return r.withColumn(out, nth.cast("long")).drop("__block", "__whole", "__count")


def running_sum(rows: DataFrame, by: list[str], order: str, value: Column, before: str, after: str, width: int | None = None) -> DataFrame:
    """``before`` and ``after``: the sum of ``value`` up to a row along ``order``, without and with it."""
    r = carried(blocked(rows, order, width).withColumn("__v", value), by, __sum=(F.sum("__v"), F.sum, -1))
    w, start = inside(by, order), F.coalesce("__sum", F.lit(0.0))
    out = r.withColumns({"__b": start + F.coalesce(F.sum("__v").over(earlier(w)), F.lit(0.0)), "__a": start + F.sum("__v").over(until(w))})
    return out.drop("__block", "__whole", "__v", "__sum").withColumnsRenamed({"__b": before, "__a": after})


def following(rows: DataFrame, by: list[str], order: str, columns: dict[str, str], width: int | None = None) -> DataFrame:
    """The values of ``columns`` in the next row along ``order``, under the given names; null in the last row."""
    one = F.struct(order, *[c for c in columns if c != order])
    r = carried(blocked(rows, order, width), by, __next=(F.min(one), F.min, 1))
    after = F.coalesce(F.lead(one).over(inside(by, order)), F.col("__next"))
    r = r.withColumn("__after", after)
    return r.select(*rows.columns, *[F.col(f"__after.{c}").alias(name) for c, name in columns.items()])


def neighbours(rows: DataFrame, by: list[str], number: str, y: str, half: int, out: str, width: int | None = None) -> DataFrame:
    """``out``: the values of ``y`` from ``half`` rows before to ``half`` rows after, by the row ``number`` of ``numbered``.

    A block also gets copies of the ``half`` rows at either border; beyond the ends of a series the array is shorter.
    """
    width = width or ROWS
    k = F.col(number)
    copies = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((k - half) / width)), F.floor((k + half) / width)))
    r = rows.withColumn("__block", copies)
    near = F.collect_list(F.struct(y)).over(inside(by, number).rowsBetween(-half, half))
    r = r.withColumn("__near", near).filter(F.floor(k / width) == F.col("__block"))
    return r.withColumn(out, F.transform("__near", lambda s: s[y])).drop("__block", "__near")
