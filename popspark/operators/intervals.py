"""Interval algebra on tables (chrom, start, end), 0-based and half-open.

Windows run over blocks of a chromosome (``scans``): what reaches into a block from earlier ones is carried in, so no
task sorts a chromosome's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popspark.operators import scans
from popspark.operators.rangejoin import BUCKET, overlaps, within

PIECE = ["chrom", "start", "end"]


def tile(seqlens: DataFrame, width: int) -> DataFrame:
    """Windows (chrom, bin, start, end) that cover each chromosome; the last is clipped."""
    bins = F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("length") - 1), F.lit(width))).alias("bin", "start")
    t = seqlens.filter("length > 0").select("chrom", "length", bins)
    return t.select("chrom", "bin", F.col("start").cast("long").alias("start"), F.least(F.col("start") + width, F.col("length")).cast("long").alias("end"))


def drop_empty(ranges: DataFrame) -> DataFrame:
    return ranges.filter(F.col("end") > F.col("start"))


def islands(rows: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """``rows`` with ``island``, the first start of the intervals that touch (or are ``gap`` bases apart) within ``by``."""
    r = scans.carried(scans.blocked(rows, "start"), by, __reach=(F.max("end"), F.max, -1))
    reach = F.greatest(F.max("end").over(scans.earlier(scans.inside(by, "start", "end"))), F.col("__reach"))
    r = r.withColumn("__new", F.coalesce(F.col("start") > reach + gap, F.lit(True)))
    return scans.begun(r, by, F.col("__new"), "start", "island", "start", "end").drop("__new", "__reach", "__block", "__whole")


def merge(ranges: DataFrame, gap: int = 0, by: list[str] | None = None, **aggs: Column) -> DataFrame:
    """Union of overlapping or adjacent intervals; ``aggs`` summarise the members of each (name=Column)."""
    by = by or ["chrom"]
    rows = drop_empty(ranges)
    rows = islands(rows if aggs else rows.select(*by, "start", "end"), by, gap)
    out = rows.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in aggs.items()])
    return out.drop("island")


def complement(ranges: DataFrame, seqlens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What the intervals leave of each chromosome, or of each key ``by`` of ``seqlens`` (by, length)."""
    by = by or ["chrom"]
    m = merge(ranges, by=by).join(seqlens.select(*by), by, "left_semi")
    m = scans.carried(scans.blocked(m, "start"), by, __last=(F.max("end"), F.max, -1))
    before = F.coalesce(F.lag("end").over(scans.inside(by, "start")), F.col("__last"), F.lit(0))
    inner = m.select(*by, before.cast("long").alias("start"), F.col("start").alias("end"))
    last = m.groupBy(*by).agg(F.max("end").alias("start"))
    tail = seqlens.join(last, by, "left").select(*by, F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("length").alias("end"))
    return drop_empty(inner.unionByName(tail))


def intersect(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Common parts of every overlapping pair, with the other columns of ``a``."""
    rest = [c for c in a.columns if c not in PIECE]
    return overlaps(a, b.select(*PIECE), bucket).select("chrom", F.col("lo").alias("start"), F.col("hi").alias("end"), *rest)


def subtract(a: DataFrame, b: DataFrame, seqlens: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """What ``b`` leaves of each interval of ``a``."""
    return intersect(a, complement(b, seqlens), bucket)


def subtract_within(a: DataFrame, b: DataFrame, by: list[str], bucket: int = BUCKET) -> DataFrame:
    """What the intervals of ``b`` with the same keys ``by`` (chromosome and gene, say) leave of each interval of ``a``."""
    rest = [c for c in a.columns if c not in ("start", "end")]
    # only an interval's own bases are looked at: the gaps between a key's parts may be as long as the chromosome
    own = drop_empty(a.withColumn("start", F.greatest("start", F.lit(0).cast(a.schema["start"].dataType)))).dropna(subset=by)
    own = own.groupBy(*a.columns).agg(F.count("*").alias("__n"))
    cut = overlaps(own, merge(b, by=by), bucket, by).select(*own.columns, "lo", "hi")
    # an interval begins where an empty cut ends; along its cuts, which are disjoint, what is left lies from one to the next
    begin = own.withColumns({"lo": F.col("start") - 1, "hi": F.col("start")})
    after = scans.following(begin.unionByName(cut), own.columns, "lo", {"lo": "__next"}).select(*own.columns, F.col("hi").alias("lo"), F.coalesce("__next", "end").alias("hi"))
    left = after.filter("hi > lo").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return left.select(*rest, F.col("lo").alias("start"), F.col("hi").alias("end"))


def introns(genes: DataFrame, exons: DataFrame, utrs: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Merged genes less exons and untranslated regions, as merged intervals.

    With ``by``, a column that names the gene, each gene loses its own parts only; without it those of all genes.
    """
    keys = ["chrom", by] if by else ["chrom"]
    pick = lambda d: d.select(*keys, "start", "end")
    parts = pick(exons).unionByName(pick(utrs)) if utrs is not None else pick(exons)
    # what is left of merged genes by merged parts is disjoint and apart
    return subtract_within(merge(pick(genes), by=keys), parts, keys)


def conservative(ranges: DataFrame, buffer: int = 20, mode: str = "shrink") -> DataFrame:
    """Introns without ``buffer`` bases that splicing may conserve at either end (see ``shrink`` for ``mode``)."""
    return shrink(ranges, buffer, mode)


def label_set(tracks: dict[str, DataFrame], seqlens: DataFrame | None = None, rest: str = "other", label: str = "feature") -> DataFrame:
    """Disjoint labelled pieces of named tracks; where tracks overlap the earlier name wins.

    With ``seqlens`` the set is full: what is left of the chromosomes is ``rest``.  Without, it is sparse.
    """
    rows = reduce(DataFrame.unionByName, [t.select(*PIECE).withColumn(label, F.lit(name)) for name, t in tracks.items()])
    return full_track(rows, list(tracks), seqlens, rest, label) if seqlens is not None else overlay(rows, list(tracks), label)


def slop(ranges: DataFrame, seqlens: DataFrame, size: int) -> DataFrame:
    """Each interval longer by ``size`` on both sides, within its chromosome."""
    j = ranges.join(seqlens, "chrom")
    return j.withColumns({"start": F.greatest(F.col("start") - size, F.lit(0)).cast("long"), "end": F.least(F.col("end") + size, F.col("length"))}).drop("length")


def flank(ranges: DataFrame, seqlens: DataFrame, left: int, right: int) -> DataFrame:
    """The ``left`` bases before and ``right`` bases after each interval, seen along its strand (column strand, optional)."""
    strand = F.col("strand") if "strand" in ranges.columns else F.lit("+")
    before = F.when(strand == "-", right).otherwise(left)
    after = F.when(strand == "-", left).otherwise(right)
    j = ranges.join(seqlens, "chrom")
    up = j.withColumns({"end": F.col("start"), "start": F.greatest(F.col("start") - before, F.lit(0)).cast("long")})
    down = j.withColumns({"start": F.col("end"), "end": F.least(F.col("end") + after, F.col("length"))})
    return drop_empty(up.unionByName(down)).drop("length")


def shrink(ranges: DataFrame, size: int = 20, mode: str = "shrink") -> DataFrame:
    """Take ``size`` bases off both ends, or, with ``mode='shift'``, move the interval left by as much."""
    start = F.col("start") + size if mode == "shrink" else F.col("start") - size
    return drop_empty(ranges.withColumns({"start": start, "end": F.col("end") - size}))


def runs(rows: DataFrame, label: str, drop_null: bool = True) -> DataFrame:
    """Adjacent disjoint pieces of one label as one range."""
    one = F.struct("start", "end", F.col(label).alias("label"))
    r = scans.carried(scans.blocked(rows.select(*PIECE, label), "start"), ["chrom"], __last=(F.max(one), F.max, -1))
    r = r.withColumn("__last", F.coalesce(F.lag(one).over(scans.inside(["chrom"], "start")), F.col("__last")))
    new = ~(F.col(label).eqNullSafe(F.col("__last.label")) & (F.col("__last.end") == F.col("start")))
    r = scans.begun(r.withColumn("__new", F.coalesce(new, F.lit(True))), ["chrom"], F.col("__new"), "start", "__run", "start")
    out = r.groupBy("chrom", "__run", label).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*PIECE, label)
    return out.filter(F.col(label).isNotNull()) if drop_null else out


def overlay(tracks: DataFrame, priority: list[str], label: str = "feature") -> DataFrame:
    """Disjoint labelled pieces; where labels overlap the first in ``priority`` wins, others are left out.

    One scan over the ends of all intervals counts how many of each label are open; a piece begins where the first open label changes.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(label)).cast("int")
    t = drop_empty(tracks).dropna(subset=["chrom"]).withColumn("__rank", rank).filter("__rank > 0")
    end = lambda c, n: F.struct(F.col(c).alias("start"), F.lit(n).cast("long").alias("n"))
    ends = t.select("chrom", "__rank", F.explode(F.array(end("start", 1), end("end", -1))).alias("e")).select("chrom", "__rank", "e.start", "e.n")
    ranks = range(1, len(priority) + 1)
    edges = ends.groupBy("chrom", "start").agg(*[F.sum(F.when(F.col("__rank") == k, F.col("n")).otherwise(0)).alias(f"__n{k}") for k in ranks])
    r = scans.carried(scans.blocked(edges, "start"), ["chrom"], **{f"__c{k}": (F.sum(f"__n{k}"), F.sum, -1) for k in ranks})
    until = scans.until(scans.inside(["chrom"], "start"))
    r = r.withColumns({f"__o{k}": F.coalesce(f"__c{k}", F.lit(0)) + F.sum(f"__n{k}").over(until) for k in ranks})
    none = F.lit(None).cast("int")
    after = F.coalesce(*[F.when(F.col(f"__o{k}") > 0, k) for k in ranks], none)
    before = F.coalesce(*[F.when(F.col(f"__o{k}") > F.col(f"__n{k}"), k) for k in ranks], none)
    changes = r.filter(~before.eqNullSafe(after)).select("chrom", "start", after.alias("__rank"))
    out = scans.following(changes, ["chrom"], "start", {"start": "end"}).filter("__rank IS NOT NULL")
    return out.select(*PIECE, F.element_at(F.array(*[F.lit(p) for p in priority]), F.col("__rank")).alias(label))


def full_track(tracks: DataFrame, priority: list[str], seqlens: DataFrame, rest: str = "other", label: str = "feature") -> DataFrame:
    """``overlay`` with what is left of the chromosomes as ``rest``."""
    o = overlay(tracks, priority, label)
    return o.unionByName(complement(o, seqlens).withColumn(label, F.lit(rest)))


def coverage(windows: DataFrame, track: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each window: overlapping intervals, bases they cover (each base once), width and fraction."""
    keys = [c for c in windows.columns]
    hits = overlaps(windows, track.select(*PIECE), bucket).groupBy("chrom", "start", "end").agg(F.count("*").alias("n_overlaps"))
    bases = overlaps(windows, merge(track), bucket).groupBy("chrom", "start", "end").agg(F.sum(F.col("hi") - F.col("lo")).alias("bases"))
    j = windows.join(hits, PIECE, "left").join(bases, PIECE, "left").fillna(0, ["n_overlaps", "bases"])
    width = F.col("end") - F.col("start")
    return j.select(*keys, "n_overlaps", "bases", width.alias("width"), (F.col("bases") / width).alias("fraction"))


def centre_bases(covered: DataFrame) -> DataFrame:
    """One interval at each window's centre as long as the bases it covers."""
    mid = (F.col("start") + F.col("end")) / 2
    start = F.floor(mid - F.col("bases") / 2).cast("long")
    return drop_empty(covered.select("chrom", start.alias("start"), (start + F.col("bases")).alias("end")))


def contains_overlaps(ranges: DataFrame) -> DataFrame:
    """(chrom, overlapping) for each chromosome."""
    r = scans.carried(scans.blocked(drop_empty(ranges), "start"), ["chrom"], __reach=(F.max("end"), F.max, -1))
    reach = F.greatest(F.max("end").over(scans.earlier(scans.inside(["chrom"], "start", "end"))), F.col("__reach"))
    return r.withColumn("__o", F.coalesce(reach > F.col("start"), F.lit(False))).groupBy("chrom").agg(F.max("__o").alias("overlapping"))


def classify(sites: DataFrame, ranges: DataFrame, label: str = "feature", missing: str | None = "missing", bucket: int = BUCKET) -> DataFrame:
    """Sites with the label of the disjoint range that holds them."""
    return within(sites, ranges.select(*PIECE, label), "left", bucket).select(*sites.columns, F.coalesce(label, F.lit(missing)).alias(label))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bases in common, in either, and their ratio."""
    size = lambda d: merge(d).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n"))
    both = size(intersect(merge(a), merge(b))).withColumnRenamed("n", "common")
    either = size(a.select(*PIECE).unionByName(b.select(*PIECE))).withColumnRenamed("n", "total")
    return both.crossJoin(either).withColumn("jaccard", F.col("common") / F.nullif(F.col("total"), F.lit(0)))


def split(features: DataFrame, recmap: DataFrame, length: int | None = None, bucket: int = BUCKET, strict: bool = True) -> DataFrame:
    """Features cut where the rate changes and into chunks of ``length`` from the left, with rate and map positions.

    A part without a rate ends the job with an error; without ``strict`` such parts are left out (``uncovered`` has
    them).
    """
    f, known = features, recmap.filter(F.col("rate").isNotNull()) if strict else recmap
    if length:
        at = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(length))).alias("__at")
        f = drop_empty(f).select("*", at).withColumns({"end": F.least(F.col("__at") + length, F.col("end")), "start": F.col("__at")}).drop("__at")
    if strict:
        unrated = complement(known, drop_empty(features).groupBy("chrom").agg(F.max("end").alias("length")))
        place = F.concat(F.lit("no rate at "), "chrom", F.lit(":"), F.col("lo").cast("string"))
        # no row remains of these: the filter raises for the first one
        wrong = overlaps(drop_empty(features), unrated, bucket).filter(F.raise_error(place).cast("boolean")).select(*features.columns)
        f = f.unionByName(wrong)
    cut = overlaps(f, known.select(*PIECE, "rate", "cum_start"), bucket)
    rest = [c for c in features.columns if c not in PIECE]
    where = lambda x: F.col("cum_start") + (F.col(x) - F.col("b_start")) * F.col("rate")
    return cut.select("chrom", F.col("lo").alias("start"), F.col("hi").alias("end"), *rest, "rate", where("lo").alias("map_start"), where("hi").alias("map_end"))


def uncovered(features: DataFrame, recmap: DataFrame) -> DataFrame:
    """(chrom, start, end): the parts of features, merged, that have no rate; a caller that needs all of them has an error where there are any."""
    rated = recmap.filter(F.col("rate").isNotNull())
    return subtract(merge(features), merge(rated), features.groupBy("chrom").agg(F.max("end").alias("length")))


def rate_track(ranges: DataFrame, seqlens: DataFrame, rate: float) -> DataFrame:
    """A map without gaps: ``rate`` inside the intervals, 0 elsewhere."""
    inside = merge(ranges).withColumn("rate", F.lit(float(rate)))
    return inside.unionByName(complement(ranges, seqlens).withColumn("rate", F.lit(0.0)))


def span(ranges: DataFrame) -> DataFrame:
    """With length and midpoint."""
    return ranges.withColumns({"length": F.col("end") - F.col("start"), "midpoint": (F.col("start") + F.col("end")) / 2})


def to_bed(rows: DataFrame) -> DataFrame:
    """1-based closed to 0-based half-open."""
    return rows.withColumn("start", F.col("start") - 1)


def to_gff(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start") + 1)


def neutral_track(features: DataFrame, seqlens: DataFrame, size: int) -> DataFrame:
    """What lies more than ``size`` bases from any feature."""
    return complement(slop(features, seqlens, size), seqlens)


def union(*tracks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*PIECE) for t in tracks])


def threshold(track: DataFrame, cut: float, below: bool = False, label: str | None = None) -> DataFrame:
    """Merged intervals of a score track at or beyond ``cut``."""
    t = merge(track.filter(F.col("score") <= cut if below else F.col("score") >= cut))
    return t.withColumn("feature", F.lit(label)) if label else t
