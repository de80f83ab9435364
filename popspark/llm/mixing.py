"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every document of a source gets the same expected number of copies, target / source size.  Its fraction is
rounded with the others' of its source: two documents at a time, words of probability mass move from one to the
other in a random direction until one of them is integral; expectations and the source's expected words stay as
they are.  Groups of about ``GROUP`` documents, chosen by hash, fold their members in this way inside one array
expression and hand one fractional residual up; the next level groups the residuals, and so on to one for each
source: a reduction tree of bounded groups whatever the size of a source.

A residual is usually one of the longest documents, and rounding it would miss the target by up to its length.
So the tree runs twice: over the documents longer than their source's mean, whose last residual is rounded at
random, and then over the shorter ones, whose fractions take up what that rounding gained or lost.  What a source
misses is then about half a short document.

Random numbers are hashes of seed, level and what a row holds, so reruns agree on any partitioning.

Defined results: null text has size 0; documents of size 0 take nothing; a null source is a source, last in
order; rows that repeat a doc_id are told apart by source and text, equal ones are interchangeable; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.llm.common import WORD, documents, stored, unused

GROUP = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def numbered(docs: DataFrame, identity: str = "doc_id") -> DataFrame:
    """doc_id (of the column ``identity``), source, size in words and ``dup``, a hash that no two rows share, equal ones neither."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.xxhash64("doc_id", "source", "text")
    rows = docs.select(F.col(identity).alias("doc_id"), "source", size.alias("size"), same.alias("same"))
    nth = F.row_number().over(W.partitionBy("same").orderBy("same"))
    return rows.select("doc_id", "source", "size", F.xxhash64("same", nth).alias("dup"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources whose fair share exceeds ``cap`` times their size stop there and the rest is shared anew; that is the
    water level at which least(cap * size, level * weight) add up.  Works on one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(every, nth % len(weights)))
    per = per.withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(whole) * F.lit(share)
    per = per.withColumn("level", (total - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    level = F.first(F.when(F.col("full_at") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    most = F.lit(cap) * F.col("source_size")
    return per.withColumn("at", level).select("source", "source_size", F.coalesce(F.least(most, F.col("at") * F.col("weight")), most).alias("target"))


def _unit(*cols) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _fold(items: F.Column) -> F.Column:
    """Fold structs (u, doc_id, dup, size, p) to a struct of the last fractional one and the decided ones."""
    first = F.element_at(items, 1)
    start = F.struct(*[first[c].alias(c) for c in ("doc_id", "dup", "size", "p")], F.array().cast("array<struct<doc_id:bigint,dup:bigint,size:bigint,up:int>>").alias("done"))

    def step(a, b):
        ratio = b["size"].cast("double") / a["size"]
        up, down = F.least(1 - a["p"], b["p"] * ratio), F.least(a["p"], (1 - b["p"]) * ratio)
        rise = b["u"] * (up + down) < down
        a_ends = F.when(rise, 1 - a["p"] <= b["p"] * ratio).otherwise(a["p"] <= (1 - b["p"]) * ratio)
        a_p = F.when(rise, a["p"] + up).otherwise(a["p"] - down)
        b_p = F.when(rise, b["p"] - up / ratio).otherwise(b["p"] + down / ratio)
        end = lambda x, v: F.array(F.struct(x["doc_id"], x["dup"], x["size"], v.cast("int").alias("up")))
        done = F.when(a_ends, end(a, rise)).otherwise(end(b, ~rise))
        pick = lambda c: F.when(a_ends, b[c]).otherwise(a[c]).alias(c)
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a_ends, b_p).otherwise(a_p))).alias("p")
        return F.struct(pick("doc_id"), pick("dup"), pick("size"), p, F.concat(a["done"], done).alias("done"))

    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def pivotal(items: DataFrame, seed: int, nearest: bool) -> DataFrame:
    """Round the fractions ``p`` of items (source, doc_id, dup, size, p; size > 0) within each source.

    Returns source, doc_id, dup, size, up (0 or 1).  The last of a source goes to the nearest integer or, without
    ``nearest``, to a random one.
    """
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    rest = stored(items.join(counts, items["source"].eqNullSafe(counts["source"])).select(items["*"], "n"), "fractions")
    most = rest.agg(F.max("n")).first()[0] or 0
    decided, level, groups = [], 0, most
    while groups > 1:
        level += 1
        groups = -(-groups // GROUP)
        buckets = F.ceil(F.col("n") / F.lit(float(GROUP) ** level))
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "dup"), buckets)
        member = F.struct(_unit(F.lit(-seed), F.lit(level), "dup").alias("u"), "doc_id", "dup", "size", "p")
        folded = rest.groupBy("source", "n", bucket.alias("bucket")).agg(_fold(F.array_sort(F.collect_list(member))).alias("x"))
        folded = stored(folded.select("source", "n", "x.*"), "folded")
        decided.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        rest = folded.drop("done")
    coin = F.lit(0.5) if nearest else _unit(F.lit(seed), F.lit("last"), "dup")
    decided.append(rest.select("source", "doc_id", "dup", "size", (coin < F.col("p")).cast("int").alias("up")))
    return reduce(DataFrame.unionByName, decided)


def _rounded(items: DataFrame, seed: int, nearest: bool) -> DataFrame:
    """copies for items (source, doc_id, dup, size, p): whole part of p plus its rounded fraction."""
    base, part = F.floor("p"), F.col("p") - F.floor("p")
    live = (F.col("size") > 0) & (part > 0)
    done = items.filter(~live).select("source", "doc_id", "dup", "size", F.when(F.col("size") > 0, base).otherwise(0).cast("long").alias("copies"))
    up = pivotal(items.filter(live).withColumn("p", part), seed, nearest)
    whole = items.select("source", F.floor("p").alias("base")).distinct()
    up = up.join(whole, up["source"].eqNullSafe(whole["source"])).select(up["*"], "base")
    return stored(done.unionByName(up.select("source", "doc_id", "dup", "size", (F.col("base") + F.col("up")).alias("copies"))), "copies")


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, identity: str = "doc_id") -> DataFrame:
    """doc_id, dup, source, size, source_size, target, copies, taken for each row of ``docs``; ``identity`` names the column that is handed back as doc_id."""
    rows = stored(numbered(docs, identity), "sizes")
    goal = stored(targets(rows, weights, share, cap), "targets")
    split = rows.groupBy("source").agg(F.avg("size").alias("mean"))
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = goal.join(split, on(goal, split)).select(goal["*"], "mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("p"))
    items = stored(rows.join(plan, on(rows, plan)).select(rows["*"], "p", (F.col("size") > F.col("mean")).alias("long")), "items")
    long = _rounded(items.filter("long").drop("long"), seed, nearest=False)
    used = long.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"))
    short = items.filter("not long").drop("long", "p")
    words = short.groupBy("source").agg(F.sum("size").alias("words"))
    left = goal.join(words, on(goal, words)).join(used, on(goal, used), "left")
    rest = F.col("target") - F.coalesce("used", F.lit(0))
    left = left.select(goal["source"], F.when(F.col("words") > 0, F.least(F.lit(cap), F.greatest(F.lit(0.0), rest / F.col("words")))).otherwise(0.0).alias("p"))
    short = short.join(left, on(short, left)).select(short["*"], "p")
    both = long.unionByName(_rounded(short, seed + 1, nearest=True))
    out = both.join(goal, on(both, goal)).select("doc_id", "dup", both["source"], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    return out


def repeated(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, columns unchanged."""
    key, copies = unused(docs, "key"), unused(docs, "copies_taken")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    # random numbers come from what a row holds, the row's number only leads back to it
    taken = mix(rows, seed, identity=key).filter("copies > 0")
    taken = stored(taken.select(F.col("doc_id").alias(key), F.col("copies").cast("int").alias(copies)), "taken")
    rows = rows.join(taken.hint("merge"), key)
    return rows.withColumn(key, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
