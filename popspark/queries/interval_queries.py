"""Interval algebra (INT), tilings, joins (JON) and filters (FLT) on the derived tracks."""

from pyspark.sql import functions as F

from popspark.functions import scalars as S
from popspark.operators import genmap, intervals as I, rangejoin as R
from popspark.queries.views import ACCESS, FEATURES, NEUTRAL, RECMAP, gaps, merged, query, tiles

OUT = 'chrom, s AS start, e AS "end"'
WIDTH = 1000
ALL = merged("allf", "SELECT chrom, s, e FROM feats")


@query("int01_tile", 'SELECT chrom, bin, s AS start, e AS "end" FROM tiles', tiles(WIDTH))
def _(v):
    return I.tile(v.seqlens, WIDTH)


@query("int02_membership", "SELECT chrom, pos FROM sites WHERE EXISTS (SELECT 1 FROM neutral n WHERE n.chrom = sites.chrom AND pos >= n.s AND pos < n.e)", NEUTRAL)
def _(v):
    return R.within(v.sites.select("chrom", "pos"), v.neutral)


OVERLAY = (
    """edges AS (SELECT chrom, s AS x FROM feats WHERE feature IN ('1-URGENT','2-HIGH','3-MEDIUM') UNION SELECT chrom, e FROM feats WHERE feature IN ('1-URGENT','2-HIGH','3-MEDIUM')),
pieces AS (SELECT chrom, x AS s, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS e FROM edges),
best AS (SELECT p.chrom, p.s, p.e, min(f.feature) AS feature FROM pieces p JOIN feats f ON f.chrom = p.chrom AND f.s < p.e AND p.s < f.e WHERE f.feature IN ('1-URGENT','2-HIGH','3-MEDIUM') GROUP BY 1, 2, 3),
best_1 AS (SELECT *, CASE WHEN feature = lag(feature) OVER w AND s = lag(e) OVER w THEN 0 ELSE 1 END AS n FROM best WINDOW w AS (PARTITION BY chrom ORDER BY s)),
best_2 AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM best_1),
overlay AS (SELECT chrom, min(s) AS s, max(e) AS e, any_value(feature) AS feature FROM best_2 GROUP BY chrom, i)"""
)


@query("int03_overlay", f"SELECT {OUT}, feature FROM overlay", OVERLAY)
def _(v):
    return I.overlay(v.feats, FEATURES)


@query(
    "int04_runs",
    f"SELECT {OUT}, label FROM r",
    "b AS (SELECT chrom, s, e, CASE WHEN score > 50 THEN 'high' ELSE 'low' END AS label FROM track)",
    "b1 AS (SELECT chrom, s // 60 AS k, min(s // 60 * 60) AS s, max(s // 60 * 60 + 60) AS e, max(label) AS label FROM b GROUP BY 1, 2)",
    "b2 AS (SELECT *, CASE WHEN label = lag(label) OVER w AND s = lag(e) OVER w THEN 0 ELSE 1 END AS n FROM b1 WINDOW w AS (PARTITION BY chrom ORDER BY s))",
    "b3 AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM b2)",
    "r AS (SELECT chrom, min(s) AS s, max(e) AS e, any_value(label) AS label FROM b3 GROUP BY chrom, i)",
)
def _(v):
    t = v.track.withColumn("label", F.when(F.col("score") > 50, "high").otherwise("low"))
    cells = t.groupBy("chrom", F.floor(F.col("start") / 60).alias("k")).agg(F.max("label").alias("label"))
    return I.runs(cells.select("chrom", (F.col("k") * 60).alias("start"), (F.col("k") * 60 + 60).alias("end"), "label"), "label")


@query("int05_merge", f"SELECT {OUT} FROM allf", ALL)
def _(v):
    return I.merge(v.feats)


@query(
    "int05_merge_gap_distinct",
    'SELECT chrom, min(s) AS start, max(e) AS "end", string_agg(DISTINCT feature, \',\' ORDER BY feature) AS features, count(*) AS members FROM g2 GROUP BY chrom, i',
    "g1 AS (SELECT chrom, s, e, feature, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS n FROM feats)",
    "g2 AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM g1)",
)
def _(v):
    return I.merge(v.feats, 10, features=F.array_join(F.array_sort(F.collect_set("feature")), ","), members=F.count("*"))


@query(
    "int05_collapse_positions",
    'SELECT chrom, s AS start, e AS "end", count(*) AS n, round(avg(score), 6) AS mean, max(score) AS most FROM (SELECT chrom, s // 120 * 120 AS s, s // 120 * 120 + 1 AS e, score FROM track) GROUP BY 1, 2, 3',
)
def _(v):
    t = v.track.withColumns({"start": F.floor(F.col("start") / 120) * 120, "end": F.floor(F.col("start") / 120) * 120 + 1})
    return I.merge(t, -1, n=F.count("*"), mean=F.round(F.avg("score"), 6), most=F.max("score"))


@query("int06_complement", f"SELECT {OUT} FROM rest", ALL, gaps("rest", "allf"))
def _(v):
    return I.complement(v.feats, v.seqlens)


@query("int06_full_track", f"SELECT {OUT}, feature FROM overlay UNION ALL SELECT {OUT}, 'other' FROM rest", OVERLAY, merged("mo", "SELECT chrom, s, e FROM overlay"), gaps("rest", "mo"))
def _(v):
    return I.full_track(v.feats, FEATURES, v.seqlens)


@query(
    "int07_subtract",
    f'SELECT f.chrom, greatest(f.s, r.s) AS start, least(f.e, r.e) AS "end", feature FROM feats f JOIN rest r ON f.chrom = r.chrom AND f.s < r.e AND r.s < f.e WHERE f.status = \'O\'',
    NEUTRAL,
    gaps("rest", "neutral"),
)
def _(v):
    return I.subtract(v.feats.filter("status = 'O'").drop("status"), v.neutral, v.seqlens)


@query(
    "int08_intersect",
    'SELECT f.chrom, greatest(f.s, r.s) AS start, least(f.e, r.e) AS "end", feature FROM feats f JOIN neutral r ON f.chrom = r.chrom AND f.s < r.e AND r.s < f.e WHERE f.status = \'O\'',
    NEUTRAL,
)
def _(v):
    return I.intersect(v.feats.filter("status = 'O'").drop("status"), v.neutral)


@query("int09_slop", 'SELECT chrom, greatest(s - 25, 0) AS start, least(e + 25, length) AS "end", feature FROM feats JOIN seqlens USING (chrom)')
def _(v):
    return I.slop(v.feats.drop("status"), v.seqlens, 25)


@query(
    "int09_flank",
    """SELECT chrom, start, "end", strand FROM (
SELECT chrom, greatest(s - CASE strand WHEN '-' THEN 10 ELSE 30 END, 0) AS start, s AS "end", strand FROM f
UNION ALL SELECT chrom, e, least(e + CASE strand WHEN '-' THEN 30 ELSE 10 END, length), strand FROM f) WHERE "end" > start""",
    "f AS (SELECT feats.*, length, CASE WHEN status = 'F' THEN '-' ELSE '+' END AS strand FROM feats JOIN seqlens USING (chrom))",
)
def _(v):
    f = v.feats.select("chrom", "start", "end", F.when(F.col("status") == "F", "-").otherwise("+").alias("strand"))
    return I.flank(f, v.seqlens, 30, 10)


COVERAGE = (
    tiles(WIDTH),
    NEUTRAL,
    """cov AS (SELECT t.chrom, t.bin, t.s, t.e, coalesce(n, 0) AS n_overlaps, coalesce(b, 0)::BIGINT AS bases FROM tiles t
LEFT JOIN (SELECT t.chrom, t.bin, count(*) AS n FROM tiles t JOIN feats f ON f.chrom = t.chrom AND f.s < t.e AND t.s < f.e WHERE f.status = 'F' GROUP BY 1, 2) x USING (chrom, bin)
LEFT JOIN (SELECT t.chrom, t.bin, sum(least(f.e, t.e) - greatest(f.s, t.s)) AS b FROM tiles t JOIN neutral f ON f.chrom = t.chrom AND f.s < t.e AND t.s < f.e GROUP BY 1, 2) y USING (chrom, bin))""",
)


@query("int10_coverage", 'SELECT chrom, bin, s AS start, e AS "end", n_overlaps, bases, e - s AS width, round(bases / (e - s), 9) AS fraction FROM cov', *COVERAGE)
def _(v):
    c = I.coverage(I.tile(v.seqlens, WIDTH), v.feats.filter("status = 'F'"))
    return c.withColumn("fraction", F.round("fraction", 9))


@query(
    "int11_centre",
    'SELECT chrom, floor((s + e) / 2.0 - bases / 2.0)::BIGINT AS start, floor((s + e) / 2.0 - bases / 2.0)::BIGINT + bases AS "end" FROM cov WHERE bases > 0',
    *COVERAGE,
)
def _(v):
    return I.centre_bases(I.coverage(I.tile(v.seqlens, WIDTH), v.feats.filter("status = 'F'")))


@query(
    "int12_contains_overlaps",
    "SELECT chrom, bool_or(coalesce(o, false)) AS overlapping FROM (SELECT chrom, s < max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM feats) GROUP BY chrom",
)
def _(v):
    return I.contains_overlaps(v.feats)


@query(
    "int13_classify",
    "SELECT sites.chrom, pos, coalesce(o.feature, 'missing') AS feature FROM sites LEFT JOIN overlay o ON o.chrom = sites.chrom AND pos >= o.s AND pos < o.e",
    OVERLAY,
)
def _(v):
    return I.classify(v.sites.select("chrom", "pos"), I.overlay(v.feats, FEATURES))


SEGMENTS = (
    RECMAP,
    OVERLAY,
    "chunks AS (SELECT chrom, feature, k AS s, least(k + 16, e) AS e FROM overlay, LATERAL unnest(range(s, e, 16)) AS u(k))",
    """segments AS (SELECT f.chrom, greatest(f.s, r.s) AS s, least(f.e, r.e) AS e, feature, rate, c0 + (greatest(f.s, r.s) - r.s) * rate AS m0, c0 + (least(f.e, r.e) - r.s) * rate AS m1
FROM chunks f JOIN recmap r ON f.chrom = r.chrom AND f.s < r.e AND r.s < f.e)""",
)


def segments(v, recmap=None):
    return I.split(I.overlay(v.feats, FEATURES), v.recmap if recmap is None else recmap, 16, strict=False)  # some features run past the end of their chromosome


@query("int14_segments", f"SELECT {OUT}, feature, round(rate * 1e8, 6) AS rate, round(m0 * 1e6, 6) AS map_start, round(m1 * 1e6, 6) AS map_end FROM segments", *SEGMENTS)
def _(v):
    r = lambda c, k: F.round(F.col(c) * k, 6).alias(c)
    return segments(v).select("chrom", "start", "end", "feature", r("rate", 1e8), r("map_start", 1e6), r("map_end", 1e6))


@query("int15_shrink", 'SELECT chrom, s + 5 AS start, e - 5 AS "end", feature FROM feats WHERE e - 5 > s + 5')
def _(v):
    return I.shrink(v.feats.drop("status"), 5)


@query("int15_shift", 'SELECT chrom, s - 5 AS start, e - 5 AS "end", feature FROM feats')
def _(v):
    return I.shrink(v.feats.drop("status"), 5, "shift")


def gene_parts(v):
    """Genes of 32 order keys, with exons and untranslated regions by order status and priority."""
    o = v.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    f = v.feats.withColumn("gene", F.floor(F.col("start") / 256)).join(o, F.col("start") == F.col("o_orderkey") * 8)
    genes = f.groupBy("chrom", "gene").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return genes, f.filter("o_orderstatus = 'F'"), f.filter("o_orderpriority = '5-LOW'")


#: The same by single bases.
BASES = """fg AS (SELECT *, s // 256 AS gene FROM feats), genes AS (SELECT chrom, gene, min(s) AS s, max(e) AS e FROM fg GROUP BY 1, 2),
cut AS (SELECT DISTINCT chrom, gene, unnest(range(s, e)) AS p FROM fg WHERE status = 'F' OR feature = '5-LOW'),
kept AS (SELECT chrom, gene, p FROM (SELECT chrom, gene, unnest(range(s, e)) AS p FROM genes) ANTI JOIN cut USING (chrom, gene, p)),
own AS (SELECT chrom, gene, min(p) AS s, max(p) + 1 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY chrom, gene ORDER BY p) AS run FROM kept) GROUP BY chrom, gene, run),
kept_any AS (SELECT DISTINCT chrom, p FROM (SELECT chrom, unnest(range(s, e)) AS p FROM genes) ANTI JOIN (SELECT DISTINCT chrom, p FROM cut) USING (chrom, p)),
shared AS (SELECT chrom, min(p) AS s, max(p) + 1 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS run FROM kept_any) GROUP BY chrom, run)"""


@query("int16_introns", 'SELECT chrom, gene, s AS start, e AS "end" FROM own', BASES)
def _(v):
    return I.introns(*gene_parts(v), by="gene").select("chrom", "gene", "start", "end")


@query("int16_introns_of_all_genes", f"SELECT {OUT} FROM shared", BASES)
def _(v):
    return I.introns(*gene_parts(v)).select("chrom", "start", "end")


@query(
    "int16_full_labels",
    """SELECT chrom, label, sum(n)::BIGINT AS bases FROM (SELECT l.chrom, unnest(['exon', 'intron', 'other']) AS label, unnest([x.n, i.n, l.length - x.n - i.n]) AS n FROM seqlens l
JOIN (SELECT chrom, count(*) AS n FROM ex GROUP BY 1) x USING (chrom) JOIN (SELECT chrom, count(*) AS n FROM kept_any ANTI JOIN ex USING (chrom, p) SEMI JOIN (SELECT chrom, unnest(range(0, length)) AS p FROM seqlens) USING (chrom, p) GROUP BY 1) i USING (chrom)) GROUP BY 1, 2""",
    BASES,
    "ex AS (SELECT DISTINCT chrom, p FROM (SELECT chrom, unnest(range(s, e)) AS p FROM feats WHERE status = 'F') SEMI JOIN (SELECT chrom, unnest(range(0, length)) AS p FROM seqlens) USING (chrom, p))",
)
def _(v):
    genes, exons, utrs = gene_parts(v)
    inside = lambda d: I.intersect(d.select("chrom", "start", "end"), v.seqlens.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end")))
    full = I.label_set({"exon": inside(exons), "intron": inside(I.introns(genes, exons, utrs))}, v.seqlens, label="label")
    return full.groupBy("chrom", "label").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("int16_neutral", f"SELECT {OUT} FROM rest", merged("wide", "SELECT chrom, greatest(s - 4, 0) AS s, least(e + 4, length) AS e FROM feats JOIN seqlens USING (chrom)"), gaps("rest", "wide"))
def _(v):
    return I.neutral_track(v.feats, v.seqlens, 4)


@query(
    "int17_jaccard",
    "SELECT c::BIGINT AS common, t::BIGINT AS total, round(c / t, 9) AS jaccard FROM (SELECT (SELECT sum(least(a.e, b.e) - greatest(a.s, b.s)) FROM urgent a JOIN neutral b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e) AS c, (SELECT sum(e - s) FROM either) AS t)",
    NEUTRAL,
    merged("urgent", "SELECT chrom, s, e FROM feats WHERE feature = '1-URGENT'"),
    merged("either", "SELECT chrom, s, e FROM feats WHERE feature = '1-URGENT' OR status = 'F'"),
)
def _(v):
    return I.jaccard(v.feats.filter("feature = '1-URGENT'"), v.feats.filter("status = 'F'")).withColumn("jaccard", F.round("jaccard", 9))


@query(
    "int18_pairs",
    "SELECT a.chrom, a.s AS start, b.s AS b_start, a.feature, b.feature AS b_feature, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM feats a JOIN feats b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE a.status = 'P' AND b.status = 'F'",
)
def _(v):
    p = R.overlaps(v.feats.filter("status = 'P'"), v.feats.filter("status = 'F'"))
    return p.select("chrom", "start", "b_start", "feature", "b_feature", "lo", "hi")


@query(
    "int19_quantile_classes",
    f"SELECT {OUT}, class FROM r",
    "c AS (SELECT chrom, s // 240 * 240 AS s, s // 240 * 240 + 240 AS e, avg(score) AS m FROM track GROUP BY 1, 2, 3)",
    "q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS b, quantile_cont(m, 0.75) AS d FROM c)",
    "c1 AS (SELECT chrom, s, e, CASE WHEN m <= a THEN 1 WHEN m <= b THEN 2 WHEN m <= d THEN 3 ELSE 4 END AS class FROM c, q)",
    "c2 AS (SELECT *, CASE WHEN class = lag(class) OVER w AND s = lag(e) OVER w THEN 0 ELSE 1 END AS n FROM c1 WINDOW w AS (PARTITION BY chrom ORDER BY s))",
    "c3 AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS i FROM c2)",
    "r AS (SELECT chrom, min(s) AS s, max(e) AS e, any_value(class) AS class FROM c3 GROUP BY chrom, i)",
)
def _(v):
    from popspark.operators.tracks import bin_track, quantile_classes

    return I.runs(quantile_classes(bin_track(v.track, 240), [0.25, 0.5, 0.75]), "class")


@query("int21_rate_track", f"SELECT {OUT}, 0.5::DOUBLE AS rate FROM neutral UNION ALL SELECT {OUT}, 0.0 FROM rest", NEUTRAL, gaps("rest", "neutral"))
def _(v):
    return I.rate_track(v.neutral, v.seqlens, 0.5)


@query("int22_span", f"SELECT {OUT}, feature, e - s AS length, (s + e) / 2.0::DOUBLE AS midpoint FROM feats")
def _(v):
    return I.span(v.feats.drop("status"))


@query("set01_union_tracks", f"SELECT {OUT} FROM u", merged("u", "SELECT chrom, s, e FROM feats WHERE status = 'F' UNION ALL SELECT chrom, s, e FROM track WHERE score > 90"))
def _(v):
    return I.merge(I.union(v.feats.filter("status = 'F'"), v.track.filter("score > 90")))


@query("set02_difference", 'SELECT a.chrom, greatest(a.s, r.s) AS start, least(a.e, r.e) AS "end" FROM neutral a JOIN access r ON a.chrom = r.chrom AND a.s < r.e AND r.s < a.e', NEUTRAL, ACCESS)
def _(v):
    return I.subtract(v.neutral, v.feats.filter("feature = '1-URGENT'").select("chrom", "start", "end"), v.seqlens)


@query("set03_label_check", "SELECT DISTINCT feature FROM feats WHERE feature NOT IN ('1-URGENT','2-HIGH','3-MEDIUM')")
def _(v):
    known = v.spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    return v.feats.select("feature").distinct().join(known, "feature", "left_anti")


@query("set04_feature_index", "SELECT feature, (dense_rank() OVER (ORDER BY feature) - 1)::INT AS feature_id FROM (SELECT DISTINCT feature FROM feats WHERE status IN ('F','O'))")
def _(v):
    from popspark.operators.tracks import feature_index

    return feature_index(v.feats.filter("status = 'F'"), v.feats.filter("status = 'O'"))


@query("set05_both_masks", 'SELECT a.chrom, greatest(a.s, r.s) AS start, least(a.e, r.e) AS "end" FROM neutral a JOIN access r ON a.chrom = r.chrom AND a.s < r.e AND r.s < a.e', NEUTRAL, ACCESS)
def _(v):
    return I.intersect(v.neutral, v.access)


# -- joins --------------------------------------------------------------------------------------------------------


@query("jon01_sites_in_mask", "SELECT chrom, pos, n_ref, n_alt FROM sites WHERE EXISTS (SELECT 1 FROM feats n WHERE status = 'F' AND n.chrom = sites.chrom AND pos >= n.s AND pos < n.e)")
def _(v):
    return R.within(v.sites, v.feats.filter("status = 'F'"), bucket=64)


LOOKUP = """k AS (SELECT chrom, e AS x, c1 AS y FROM recmap), k1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY chrom ORDER BY x)),
k0 AS (SELECT chrom, min(x) AS x0, min_by(y, x) AS y0, max(x) AS xn, max_by(y, x) AS yn FROM k GROUP BY chrom)"""


@query(
    "jon02_map_position",
    "SELECT p.chrom, p.pos, round(1e6 * CASE WHEN p.pos <= x0 THEN y0 WHEN p.pos >= xn THEN yn ELSE y + (p.pos - x) * (y1 - y) / (x1 - x) END, 6) AS map_pos FROM sites p JOIN k0 USING (chrom) LEFT JOIN k1 ON k1.chrom = p.chrom AND p.pos >= x AND p.pos < x1",
    RECMAP,
    LOOKUP,
)
def _(v):
    return genmap.position(v.sites.select("chrom", "pos"), v.recmap).withColumn("map_pos", F.round(F.col("map_pos") * 1e6, 6))


@query(
    "jon03_rate_lookup",
    "SELECT p.chrom, p.pos, round(1e8 * CASE WHEN p.pos <= x0 THEN y0 WHEN p.pos >= xn THEN yn ELSE y + (p.pos - x) * (y1 - y) / (x1 - x) END, 6) AS rate_at FROM sites p JOIN k0 USING (chrom) LEFT JOIN k1 ON k1.chrom = p.chrom AND p.pos >= x AND p.pos < x1",
    RECMAP,
    LOOKUP.replace("c1 AS y", "rate AS y"),
)
def _(v):
    return genmap.rate_at(v.sites.select("chrom", "pos"), v.recmap).withColumn("rate_at", F.round(F.col("rate_at") * 1e8, 6))


@query(
    "jon03_inverse_lookup",
    "SELECT p.chrom, p.bin, round(CASE WHEN p.m <= x0 THEN y0 WHEN p.m >= xn THEN yn ELSE y + (p.m - x) * (y1 - y) / (x1 - x) END, 3) AS pos FROM p JOIN k0 USING (chrom) LEFT JOIN k1 ON k1.chrom = p.chrom AND p.m >= x AND p.m < x1",
    RECMAP,
    tiles(500),
    "p AS (SELECT chrom, bin, bin * 1e-6 AS m FROM tiles)",
    "k AS (SELECT chrom, c1 AS x, min(e)::DOUBLE AS y FROM recmap GROUP BY 1, 2), k1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY chrom ORDER BY x)), k0 AS (SELECT chrom, min(x) AS x0, min_by(y, x) AS y0, max(x) AS xn, max_by(y, x) AS yn FROM k GROUP BY chrom)",
)
def _(v):
    p = I.tile(v.seqlens, 500).select("chrom", "bin", (F.col("bin") * 1e-6).alias("map_pos"))
    return genmap.inverse(p, v.recmap).select("chrom", "bin", F.round("pos", 3).alias("pos"))


@query("jon05_nearest", "SELECT DISTINCT p_size, (SELECT arg_min(g, abs(g - p_size / 10.0)) FROM unnest([0.5, 1.3, 2.2, 3.1, 4.9]) u(g))::DOUBLE AS nearest FROM part")
def _(v):
    from popspark.operators.tracks import nearest

    x = v.raw("part").select("p_size").distinct().withColumn("x", F.col("p_size") / 10.0)
    return nearest(x, "x", [0.5, 1.3, 2.2, 3.1, 4.9]).drop("x")


@query("jon05_exact", "SELECT DISTINCT p_size, CASE p_size WHEN 5 THEN 0 WHEN 13 THEN 1 END::INT AS grid_id FROM part WHERE p_size IN (5, 13)")
def _(v):
    from popspark.operators.tracks import exact_index

    x = v.raw("part").select("p_size").distinct().withColumn("x", F.col("p_size") / 10.0)
    return exact_index(x, "x", [0.5, 1.3], 1e-9).select("p_size", "grid_id")


@query("jon06_window_of", f"SELECT chrom, pos, (pos // {WIDTH})::BIGINT AS bin FROM sites")
def _(v):
    return v.sites.select("chrom", "pos", F.floor(F.col("pos") / WIDTH).alias("bin"))


@query("jon09_smallest_id", "SELECT o_custkey AS gene, arg_min(o_orderkey, o_orderkey) AS transcript, count(*) AS transcripts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(v):
    from popspark.operators.tracks import smallest_mapped

    o = v.raw("orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("transcript"))
    return smallest_mapped(o, v.raw("customer").select(F.col("c_custkey").alias("gene")))


@query("jon12_weights", "SELECT chrom, n, length, round(n / length, 9) AS density FROM (SELECT chrom, count(*) AS n FROM sites GROUP BY 1) JOIN seqlens USING (chrom)")
def _(v):
    return v.sites.groupBy("chrom").agg(F.count("*").alias("n")).join(v.seqlens, "chrom").withColumn("density", F.round(F.col("n") / F.col("length"), 9))


# -- filters ------------------------------------------------------------------------------------------------------


@query("flt01_chromosomes", "SELECT chrom, pos FROM sites WHERE chrom IN ('chr1','chr3')")
def _(v):
    return v.sites.filter(F.col("chrom").isin("chr1", "chr3")).select("chrom", "pos")


@query("flt02_drop_empty", f"SELECT {OUT} FROM (SELECT chrom, s, s + (e - s) // 12 AS e FROM feats) WHERE e > s")
def _(v):
    width = F.floor((F.col("end") - F.col("start")) / 12)
    return I.drop_empty(v.feats.select("chrom", "start", (F.col("start") + width).alias("end")))


@query(
    "flt03_masked_sites",
    "SELECT chrom, pos, n_ref, n_alt FROM sites WHERE EXISTS (SELECT 1 FROM neutral n WHERE n.chrom = sites.chrom AND pos >= n.s AND pos < n.e) AND EXISTS (SELECT 1 FROM access n WHERE n.chrom = sites.chrom AND pos >= n.s AND pos < n.e)",
    NEUTRAL,
    ACCESS,
)
def _(v):
    from popspark.operators.diversity import mask_sites

    return mask_sites(v.sites, v.neutral, v.access)


@query("flt04_sequence_mask", "SELECT doc_id, sum(length(x))::BIGINT AS masked, count(*) AS pieces FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[Nnatcg]+')) AS x FROM documents) GROUP BY 1")
def _(v):
    from popspark.operators.tracks import masked_runs

    runs = masked_runs(v.raw("documents").select(F.col("doc_id").alias("chrom"), F.lit(0).alias("chunk_start"), F.col("text").alias("seq")), merge_chunks=False)
    return runs.groupBy(F.col("chrom").alias("doc_id")).agg(F.sum(F.col("end") - F.col("start")).alias("masked"), F.count("*").alias("pieces"))


@query(
    "flt05_trim_ends",
    "SELECT chrom, min(CASE WHEN c1 < 0.0001 THEN e END) AS lower, max(CASE WHEN c1 < total - 0.0001 THEN e END) AS upper FROM recmap JOIN (SELECT chrom, max(c1) AS total FROM recmap GROUP BY 1) USING (chrom) GROUP BY 1",
    RECMAP,
)
def _(v):
    return genmap.trim_ends(v.recmap, 0.01)


@query("flt08_censor", "SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events) WHERE value BETWEEN a AND b")
def _(v):
    from popspark.operators.tracks import censor

    return censor(v.raw("events").select("event_id", "value"), "value", 0.05, 0.95)


@query("flt09_threshold", f"SELECT {OUT}, 'high' AS feature FROM t", merged("t", "SELECT chrom, s, e FROM track WHERE score >= 60"))
def _(v):
    return I.threshold(v.track, 60, label="high")


CLEAN = "p AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 60 AS pos, round(p_partkey / 10.0 + p_retailprice / 50.0, 4)::DOUBLE AS cum FROM part)"


@query(
    "flt10_clean_map",
    "SELECT chrom, pos, cum FROM (SELECT *, coalesce(max(cum) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cum) AS b, coalesce(min(cum) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), cum) AS a FROM p) WHERE cum >= b AND cum <= a",
    CLEAN,
)
def _(v):
    p = v.raw("part").select(v.chrom("p_partkey"), (F.col("p_partkey") * 60).alias("pos"), F.round(F.col("p_partkey") / 10.0 + F.col("p_retailprice") / 50.0, 4).alias("cum"))
    return genmap.clean(p)


@query("flt11_finite", "SELECT p_partkey, x FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN ln(p_size - 10) END AS x FROM part) WHERE x IS NOT NULL")
def _(v):
    from popspark.operators.tracks import finite

    return finite(v.raw("part").select("p_partkey", F.when(F.col("p_size") > 10, F.log(F.col("p_size") - 10)).otherwise(float("nan")).alias("x")), "x")


@query("flt12_segment_slice", f'SELECT {OUT}, feature FROM segments WHERE chrom = \'chr2\' AND m0 <= 2.0e-5 + 5e-6 AND m1 >= 2.0e-5 - 5e-6', *SEGMENTS)
def _(v):
    from popspark.operators.tracks import map_slice

    return map_slice(segments(v), "chr2", 2.0e-5, 5e-6).select("chrom", "start", "end", "feature")


@query("flt13_bound_rate", "SELECT p_partkey, least(p_retailprice / 100, 12.0)::DOUBLE AS r, p_retailprice / 100 > 12.0 AS clipped FROM part")
def _(v):
    from popspark.operators.tracks import bound

    return bound(v.raw("part").select("p_partkey", (F.col("p_retailprice") / 100).alias("r")), "r", 12.0)


@query("flt14_min_observations", "SELECT p_size, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 40")
def _(v):
    return v.raw("part").groupBy("p_size").agg(F.count("*").alias("n")).filter("n >= 40")


# -- scalar functions on table columns ----------------------------------------------------------------------------


@query(
    "fun01_04_scalars",
    """SELECT p_partkey, round(0.5 * (1 - exp(-2 * x)), 9) AS haldane, round(-0.5 * ln(1 - 2 * x / 10), 9) AS inverse_haldane, round(-10 * log10(x), 9) + 0 AS phred,
round(10 ** (-x / 10), 9) AS inverse_phred, abs(x - 2.5) AS abs_error, round(abs(1 - x / 2.5) * 100, 6) AS rel_error, round(x / (4 * 10000.0), 12) AS bhat FROM (SELECT p_partkey, p_size / 20.0::DOUBLE AS x FROM part)""",
)
def _(v):
    x = F.col("x")
    p = v.raw("part").select("p_partkey", (F.col("p_size") / 20.0).alias("x"))
    return p.select(
        "p_partkey", F.round(S.haldane(x), 9).alias("haldane"), F.round(S.inverse_haldane(x / 10), 9).alias("inverse_haldane"), F.round(S.phred(x), 9).alias("phred"),
        F.round(S.inverse_phred(x), 9).alias("inverse_phred"), S.abs_error(x, 2.5).alias("abs_error"), F.round(S.rel_error(x, 2.5), 6).alias("rel_error"), F.round(S.bhat(x, 10000), 12).alias("bhat"),
    )


@query("fun03_signif", "SELECT p_partkey, round(p_retailprice * 10 ** (2 - floor(log10(p_retailprice)))) / 10 ** (2 - floor(log10(p_retailprice))) AS price FROM part")
def _(v):
    return v.raw("part").select("p_partkey", S.signif(F.col("p_retailprice"), 3).alias("price"))


@query("fun06_distance", "SELECT o_orderkey, greatest(1000 - o_orderkey * 8, o_orderkey * 8 - 2000, 0)::DOUBLE AS d FROM orders")
def _(v):
    return v.raw("orders").select("o_orderkey", S.segment_distance(F.col("o_orderkey") * 8, 1000, 2000).alias("d"))


@query(
    "fun07_08_pairs",
    "SELECT chrom, pos, a AS n_same, b AS n_diff, round(b / nullif(a + b, 0), 9) AS pi FROM (SELECT chrom, pos, n_ref * (n_ref - 1) / 2.0::DOUBLE + n_alt * (n_alt - 1) / 2.0::DOUBLE AS a, n_ref * n_alt::DOUBLE AS b FROM sites)",
)
def _(v):
    s = v.sites.select("chrom", "pos", S.n_same(F.col("n_ref"), F.col("n_alt")).alias("n_same"), S.n_diff(F.col("n_ref"), F.col("n_alt")).alias("n_diff"))
    return s.withColumn("pi", F.round(S.pi(F.col("n_same"), F.col("n_diff")), 9))


@query(
    "fun09_10_text",
    "SELECT chrom AS rc, s AS rs, e AS re, 'x' || feature AS label FROM feats",
)
def _(v):
    text = F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("+")).alias("region")
    f = v.feats.select(text, F.concat(F.lit("#mu=1;label=x"), F.col("feature")).alias("params"))
    r = S.parse_region(F.col("region"))
    return f.select(r["chrom"].alias("rc"), r["start"].alias("rs"), r["end"].alias("re"), S.parse_params(F.col("params"))["label"].alias("label"))


@query("fun11_gc", "SELECT doc_id, round((length(text) - length(translate(text, 'GCgc', '')))::DOUBLE / nullif(length(text) - length(translate(text, 'ACGTacgt', '')), 0), 9) AS gc FROM documents")
def _(v):
    return v.raw("documents").select("doc_id", F.round(S.gc_fraction(F.col("text")), 9).alias("gc"))


@query("fun12_log1mexp", "SELECT p_partkey, round(ln(1 - exp(-p_size / 10.0::DOUBLE)), 9) AS y FROM part")
def _(v):
    return v.raw("part").select("p_partkey", F.round(S.log1mexp(-F.col("p_size") / 10.0), 9).alias("y"))


@query(
    "fun13_16_selection",
    """SELECT p_partkey, round(exp(1e-4 * -t * L / ((1-t)*(1-t)*rf*rf + (2*t*(1-t) + 1e-8*L*(1-t)*(1-t))*rf + t*t + 1e-8*L*t*(1-t))), 9) AS b,
round(exp(-L * 1e-4 / (t * (1 + (1-t)*1e-8/t) ** 2)), 9) AS b_within, round((exp(4*t*100) - 1) / (2*0.1*t*100), 6) AS ratchet, round((1 - exp(-t)) / (1 - exp(-2*1000*t)), 9) AS pfix,
round(1 / (1 - (1 - 0.1) * (1 - rf)), 9) AS q, round(2.0/9 * t * t, 12) AS var FROM (SELECT p_partkey, p_size / 1000.0::DOUBLE AS t, 10.0::DOUBLE + p_size AS L, p_size / 500.0::DOUBLE AS rf FROM part)""",
)
def _(v):
    p = v.raw("part").select("p_partkey", (F.col("p_size") / 1000.0).alias("t"), (10.0 + F.col("p_size")).alias("L"), (F.col("p_size") / 500.0).alias("rf"))
    t, n, rf = F.col("t"), F.col("L"), F.col("rf")
    return p.select(
        "p_partkey", F.round(S.b_segment(1e-4, t, n, 1e-8, rf), 9).alias("b"), F.round(S.b_within(1e-4, t, n, 1e-8), 9).alias("b_within"), F.round(S.ratchet_time(t, 100, 0.1), 6).alias("ratchet"),
        F.round(S.p_fix(1000, t, p0=0.0005), 9).alias("pfix"), F.round(S.q_asymptotic(1.0, 0.1, rf), 9).alias("q"), F.round(S.b_variance_limit(t), 12).alias("var"),
    )


@query("fun19_report", "SELECT round(100 * avg(n_alt::DOUBLE / (n_ref + n_alt)), 3) AS alt_percent FROM sites WHERE n_ref + n_alt > 0")
def _(v):
    x = v.sites.filter("n_ref + n_alt > 0").agg(F.avg(F.col("n_alt") / (F.col("n_ref") + F.col("n_alt"))).alias("x"))
    return x.select(S.percent(F.col("x")).alias("alt_percent"))


@query("srt01_natural_order", "SELECT chrom, length, row_number() OVER (ORDER BY chrom)::INT AS nth FROM seqlens")
def _(v):
    from pyspark.sql import Window as W

    return v.seqlens.withColumn("nth", F.row_number().over(W.orderBy(genmap.chrom_key(F.col("chrom")))))


@query("srt02_sorted_output", f"SELECT {OUT}, feature FROM feats ORDER BY 1, 2, 3")
def _(v):
    return v.feats.drop("status").orderBy("chrom", "start", "end")


@query("srt03_sortedness", "SELECT chrom, bool_and(coalesce(ok, true)) AS is_sorted FROM (SELECT chrom, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= pos AS ok FROM hapmap) GROUP BY 1")
def _(v):
    return genmap.sorted_check(v.hapmap)


@query("agg25_map_length", "SELECT chrom, round(1e6 * max(c1), 6) AS map_length FROM recmap GROUP BY 1 UNION ALL SELECT NULL, round(1e6 * sum(m), 6) FROM (SELECT max(c1) AS m FROM recmap GROUP BY chrom)", RECMAP)
def _(v):
    return genmap.lengths(v.recmap).withColumn("map_length", F.round(F.col("map_length") * 1e6, 6))


@query("win01_cumulative", f"SELECT {OUT}, round(1e6 * c0, 6) AS cum_start, round(1e6 * c1, 6) AS cum_end FROM recmap", RECMAP)
def _(v):
    r = lambda c: F.round(F.col(c) * 1e6, 6).alias(c)
    return v.recmap.select("chrom", "start", "end", r("cum_start"), r("cum_end"))


@query(
    "win02_marginal",
    "SELECT chrom, e AS pos, round((lead(c) OVER w - c) / (lead(e) OVER w - e) * 1e6, 6) AS rate FROM (SELECT chrom, e, c1 * 100 AS c FROM recmap) WINDOW w AS (PARTITION BY chrom ORDER BY e)",
    RECMAP,
)
def _(v):
    p = v.recmap.select("chrom", F.col("end").alias("pos"), (F.col("cum_end") * 100).alias("cum"))
    return genmap.marginal(p).select("chrom", "pos", F.round("rate", 6).alias("rate"))
