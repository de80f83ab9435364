"""Windowed diversity (AGG), window functions (WIN), joins of windows, statistics and resampling."""

from pyspark.sql import functions as F

from popspark.operators import diversity as D, genmap, intervals as I, ordered, resample as B, stats as T, tracks
from popspark.plans import windowed
from popspark.queries.interval_queries import COVERAGE, OVERLAY, SEGMENTS, segments
from popspark.queries.views import ACCESS, FEATURES, NEUTRAL, RECMAP, merged, query, tiles

WIDTH = 1000
NSITES = "pairs AS (SELECT chrom, pos, n_ref * (n_ref - 1) / 2.0::DOUBLE + n_alt * (n_alt - 1) / 2.0::DOUBLE AS same, n_ref * n_alt::DOUBLE AS diff FROM sites)"
WINDOWS = f"""win AS (SELECT t.chrom, t.bin, t.s, t.e, coalesce(a, 0)::DOUBLE AS n_same, coalesce(b, 0)::DOUBLE AS n_diff, coalesce(n, 0)::BIGINT AS n_sites, b / nullif(a + b, 0) AS pi
FROM tiles t LEFT JOIN (SELECT chrom, pos // {WIDTH} AS bin, sum(same) AS a, sum(diff) AS b, sum((same + diff > 0)::INT) AS n FROM pairs GROUP BY 1, 2) USING (chrom, bin))"""
WIN = (tiles(WIDTH), NSITES, WINDOWS)


def windows(v):
    return D.window_pairs(v.sites, I.tile(v.seqlens, WIDTH), WIDTH)


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query(
    "windowed_pi",
    """SELECT chrom, bin, s AS start, e AS "end", n_same, n_diff, n_sites, round(pi, 9) AS pi, coalesce(pi > qa AND pi < qb, false) AS keep FROM flagged,
(SELECT quantile_cont(CASE WHEN ok THEN pi END, 0.05) AS qa, quantile_cont(CASE WHEN ok THEN pi END, 0.95) AS qb FROM flagged)""",
    tiles(WIDTH),
    NEUTRAL,
    ACCESS,
    NSITES.replace("FROM sites", "FROM sites WHERE EXISTS (SELECT 1 FROM neutral n WHERE n.chrom = sites.chrom AND pos >= n.s AND pos < n.e) AND EXISTS (SELECT 1 FROM access n WHERE n.chrom = sites.chrom AND pos >= n.s AND pos < n.e)"),
    WINDOWS,
    "open AS (SELECT t.chrom, t.bin, sum(least(f.e, t.e) - greatest(f.s, t.s)) AS b FROM tiles t JOIN access f ON f.chrom = t.chrom AND f.s < t.e AND t.s < f.e GROUP BY 1, 2)",
    "flagged AS (SELECT win.*, 1 - coalesce(b, 0) / (e - s) < 0.7 AS ok FROM win LEFT JOIN open USING (chrom, bin))",
)
def _(v):
    w = windowed.windowed_pi(v.sites, v.neutral, v.access, v.seqlens, WIDTH, outliers=(0.05, 0.95))
    return rounded(w, pi=9)


@query("flt06_accessible_windows", "SELECT win.chrom, win.bin, 1 - coalesce(b, 0) / (e - s) < 0.15 AS keep FROM win LEFT JOIN open USING (chrom, bin)", *WIN, ACCESS, "open AS (SELECT t.chrom, t.bin, sum(least(f.e, t.e) - greatest(f.s, t.s)) AS b FROM tiles t JOIN access f ON f.chrom = t.chrom AND f.s < t.e AND t.s < f.e GROUP BY 1, 2)")
def _(v):
    return D.flag_accessible(I.tile(v.seqlens, WIDTH), v.access, 0.15).select("chrom", "bin", "keep")


@query("flt07_outliers", "SELECT chrom, bin, coalesce(pi > a AND pi < b, false) AS keep FROM win, (SELECT quantile_cont(pi, 0.025) AS a, quantile_cont(pi, 0.975) AS b FROM win)", *WIN)
def _(v):
    return D.flag_outliers(windows(v), 0.025, 0.975).select("chrom", "bin", "keep")


@query("agg01_window_pairs", 'SELECT chrom, bin, s AS start, e AS "end", n_same, n_diff, n_sites, round(pi, 9) AS pi FROM win', *WIN)
def _(v):
    return rounded(windows(v), pi=9)


@query(
    "agg02_window_agg",
    f"SELECT t.chrom, t.bin, round(coalesce(x, 0) / (e - s), 9) AS alt, round(coalesce(y, 0)::DOUBLE / (e - s), 9) AS density FROM tiles t LEFT JOIN (SELECT chrom, pos // {WIDTH} AS bin, sum(n_alt) AS x, count(*) AS y FROM sites GROUP BY 1, 2) USING (chrom, bin)",
    tiles(WIDTH),
)
def _(v):
    w = D.window_agg(v.sites, I.tile(v.seqlens, WIDTH), WIDTH, per_base=True, alt=F.sum("n_alt"), density=F.count("*"))
    return rounded(w.select("chrom", "bin", "alt", "density"), alt=9, density=9)


@query("agg03_edges", "SELECT k::INT AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, CASE WHEN value < 10 THEN 0 WHEN value < 25 THEN 1 WHEN value < 80 THEN 2 END AS k FROM events WHERE value >= 1 AND value < 80) GROUP BY 1")
def _(v):
    return rounded(D.edge_agg(v.raw("events"), [1, 10, 25, 80], "value", n=F.count("*"), mean=F.avg("value")), mean=6)


for name, weight in (("pairs", "a + b"), ("sites", "n")):

    @query(f"agg04_pi_by_{name}", f"SELECT chrom, round(b / (a + b), 9) AS pi, ({weight})::DOUBLE AS weight FROM c UNION ALL SELECT NULL, round(sum(b / (a + b) * ({weight})) / sum({weight}), 9), sum({weight})::DOUBLE FROM c", NSITES, "c AS (SELECT chrom, sum(same) AS a, sum(diff) AS b, count(*) AS n FROM pairs GROUP BY 1)")
    def _(v, by_pairs=name == "pairs"):
        return rounded(D.chromosome_pi(v.sites, by_pairs), pi=9)


@query("agg05_polymorphic", "SELECT chrom, sum((n_ref > 0)::INT + (n_alt > 0)::INT)::BIGINT AS cells, sum((n_ref > 0 AND n_alt > 0)::INT)::BIGINT AS polymorphic FROM sites GROUP BY 1")
def _(v):
    return D.polymorphic(v.sites)


@query(
    "agg06_mask_stats",
    "SELECT chrom, round(coalesce(a, 0) / length, 9) AS neutral, round(coalesce(b, 0) / length, 9) AS accessible, round(coalesce(c, 0) / length, 9) AS both FROM seqlens LEFT JOIN (SELECT chrom, sum(e - s) AS a FROM neutral GROUP BY 1) USING (chrom) LEFT JOIN (SELECT chrom, sum(e - s) AS b FROM access GROUP BY 1) USING (chrom) LEFT JOIN (SELECT x.chrom, sum(least(x.e, y.e) - greatest(x.s, y.s)) AS c FROM neutral x JOIN access y ON x.chrom = y.chrom AND x.s < y.e AND y.s < x.e GROUP BY 1) USING (chrom)",
    NEUTRAL,
    ACCESS,
)
def _(v):
    return rounded(D.mask_stats(v.neutral, v.access, v.seqlens), neutral=9, accessible=9, both=9)


@query("agg07_feature_stats", "SELECT chrom, feature, count(*) AS n, sum(e - s)::BIGINT AS bases, round(sum(e - s) / CASE WHEN chrom IS NULL THEN (SELECT sum(length) FROM seqlens) ELSE max(length) END, 9) AS fraction FROM feats JOIN seqlens USING (chrom) GROUP BY GROUPING SETS ((chrom, feature), (feature))")
def _(v):
    return rounded(D.feature_stats(v.feats, v.seqlens), fraction=9)


@query(
    "agg08_describe",
    "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(var_pop(value), 6) AS var, min(value) AS min, max(value) AS max, min(nullif(value, 0)) AS non_zero_min, round(quantile_cont(value, 0.1), 6) AS lower10, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.9), 6) AS upper10, round(sum(value), 4) AS total FROM events",
)
def _(v):
    d = T.describe(v.raw("events"), "value")
    return rounded(d, mean=6, median=6, var=6, lower10=6, q25=6, upper10=6, total=4)


AT = """(CASE WHEN {p} <= x0 THEN y0 WHEN {p} >= xn THEN yn ELSE (SELECT y + ({p} - x) * (y1 - y) / (x1 - x) FROM k1 WHERE k1.chrom = t.chrom AND {p} >= x AND {p} < x1) END)"""
KNOTS = "k AS (SELECT chrom, e AS x, c1 AS y FROM recmap), k1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY chrom ORDER BY x)), k0 AS (SELECT chrom, min(x) AS x0, min_by(y, x) AS y0, max(x) AS xn, max_by(y, x) AS yn FROM k GROUP BY chrom)"
RATES = (RECMAP, KNOTS, f"rates AS (SELECT t.chrom, t.bin, ({AT.format(p='t.e')} - {AT.format(p='t.s')}) / (t.e - t.s) AS rec_rate FROM tiles t JOIN k0 USING (chrom))")


@query("agg20_window_rates", "SELECT chrom, bin, round(rec_rate * 1e8, 6) AS rec_rate FROM rates", tiles(WIDTH), *RATES)
def _(v):
    w = genmap.window_rates(I.tile(v.seqlens, WIDTH), v.recmap)
    return w.select("chrom", "bin", F.round(F.col("rec_rate") * 1e8, 6).alias("rec_rate"))


@query(
    "agg09_window_table",
    "SELECT win.chrom, win.bin, f.feature, coalesce(bases, 0)::BIGINT AS bases, round(rec_rate * 1e8, 6) AS rec_rate, round(pi, 9) AS pi FROM win JOIN rates USING (chrom, bin) CROSS JOIN (SELECT DISTINCT feature FROM overlay) f LEFT JOIN cov c ON c.chrom = win.chrom AND c.bin = win.bin AND c.feature = f.feature",
    *WIN,
    *RATES,
    OVERLAY,
    "cov AS (SELECT t.chrom, t.bin, o.feature, sum(least(o.e, t.e) - greatest(o.s, t.s)) AS bases FROM tiles t JOIN overlay o ON o.chrom = t.chrom AND o.s < t.e AND t.s < o.e GROUP BY 1, 2, 3)",
)
def _(v):
    t = windowed.window_table(v.sites, I.overlay(v.feats, FEATURES), v.recmap, v.seqlens, WIDTH)
    return t.select("chrom", "bin", "feature", "bases", F.round(F.col("rec_rate") * 1e8, 6).alias("rec_rate"), F.round("pi", 9).alias("pi"))


@query("agg11_bin_track", 'SELECT chrom, s // 240 * 240 AS start, s // 240 * 240 + 240 AS "end", round(avg(score), 6) AS value FROM track GROUP BY 1, 2, 3')
def _(v):
    return rounded(tracks.bin_track(v.track, 240), value=6)


@query(
    "agg12_binned",
    """SELECT b AS bin, 1.0 + 4.9 * b AS start, 1.0 + 4.9 * (b + 1) AS "end", round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, n FROM
(SELECT least(floor((p_size - 1) / 4.9), 9)::INT AS b, avg(p_retailprice) AS mean, quantile_cont(p_retailprice, 0.5) AS median, stddev_pop(p_retailprice) AS sd, count(*) AS n FROM part GROUP BY 1)""".replace("1.0 + 4.9 * b AS start", "round(1.0::DOUBLE + 4.9 * b, 6) AS start").replace('1.0 + 4.9 * (b + 1) AS "end"', 'round(1.0::DOUBLE + 4.9 * (b + 1), 6) AS "end"'),
)
def _(v):
    p = v.raw("part").withColumn("x", F.col("p_size").cast("double"))
    edges = [1 + 4.9 * k for k in range(10)] + [50.0]
    return rounded(T.binned(p, "x", "p_retailprice", edges), start=6, end=6, mean=6, median=6, sd=6)


@query("agg12_quantile_edges", "SELECT k::INT AS edge, quantile_cont(value, k / 4.0) AS x FROM events, unnest([0, 1, 2, 3, 4]) u(k) GROUP BY k".replace("quantile_cont(value, k / 4.0)", "CASE k WHEN 0 THEN quantile_cont(value, 0) WHEN 1 THEN quantile_cont(value, 0.25) WHEN 2 THEN quantile_cont(value, 0.5) WHEN 3 THEN quantile_cont(value, 0.75) ELSE quantile_cont(value, 1) END"))
def _(v):
    q = tracks.quantiles(v.raw("events"), "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(F.posexplode("q").alias("edge", "x"))


@query(
    "agg13_correlations",
    "SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman, count(*) AS n FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem))",
)
def _(v):
    return rounded(T.correlations(v.raw("lineitem"), "l_quantity", "l_extendedprice"), pearson=9, spearman=9)


@query("agg13_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM lineitem" for i, a in enumerate(("l_quantity", "l_discount", "l_tax")) for b in ("l_quantity", "l_discount", "l_tax")[i:]))
def _(v):
    return rounded(T.correlation_matrix(v.raw("lineitem"), ["l_quantity", "l_discount", "l_tax"]), r=9)


@query("agg14_weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def _(v):
    return rounded(T.weighted_mean(v.raw("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity"), mean=4)


@query("agg15_group_sum", "SELECT l_suppkey, sum(l_quantity) AS q, round(sum(l_tax), 6) AS t FROM lineitem GROUP BY 1")
def _(v):
    return v.raw("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_tax"), 6).alias("t"))


@query("agg16_replicates", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 9) AS mean, round(var_samp(l_discount), 9) AS var, round(stddev_pop(l_discount), 9) AS sd, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(v):
    x = "l_discount"
    g = v.raw("lineitem").groupBy("l_returnflag", "l_linestatus")
    return rounded(g.agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.stddev_pop(x).alias("sd"), F.count("*").alias("n")), mean=9, var=9, sd=9)


@query("agg17_event_counts", "SELECT event_type, user_id, (event_id // 500)::BIGINT AS at, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(v):
    return v.raw("events").groupBy("event_type", "user_id", F.floor(F.col("event_id") / 500).alias("at")).agg(F.count("*").alias("n"))


@query("agg21_track_quantiles", "SELECT k::DOUBLE AS p, CASE k WHEN 0.1 THEN quantile_cont(score, 0.1) ELSE quantile_cont(score, 0.9) END AS q FROM track, unnest([0.1, 0.9]) u(k) GROUP BY k")
def _(v):
    q = tracks.quantiles(v.track, "score", [0.1, 0.9])
    return q.select(F.explode(F.map_from_arrays(F.array(F.lit(0.1), F.lit(0.9)), "q")).alias("p", "q"))


@query("agg23_errors", "SELECT l_returnflag, round(avg((l_quantity - l_linenumber) ** 2), 6) AS l_quantity_mse, round(avg(abs(1 - l_quantity / l_linenumber)), 6) AS l_quantity_relerror, round(avg(l_quantity - l_linenumber), 6) AS l_quantity_bias FROM lineitem GROUP BY 1")
def _(v):
    e = T.errors(v.raw("lineitem"), ["l_returnflag"], "l_linenumber", ["l_quantity"])
    return rounded(e, l_quantity_mse=6, l_quantity_relerror=6, l_quantity_bias=6)


@query("agg24_cv", "SELECT chrom, round(stddev_pop(pi) / avg(pi), 9) AS cv, round(var_pop(pi), 12) AS variance FROM win GROUP BY 1", *WIN)
def _(v):
    return rounded(T.coefficient_of_variation(windows(v), ["chrom"], "pi"), cv=9, variance=12)


@query("agg26_fit_r", "SELECT round(corr(l_extendedprice, l_quantity), 9) AS r, round(corr(l_extendedprice, l_quantity) ** 2, 9) AS r2, count(*) AS n FROM lineitem")
def _(v):
    return rounded(T.fit_r(v.raw("lineitem"), "l_extendedprice", "l_quantity"), r=9, r2=9)


@query("agg28_ld_sum", "SELECT round((a - b) / 2, 3) AS ld_sum FROM (SELECT var_samp(s) AS a FROM (SELECT sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey)), (SELECT sum(v) AS b FROM (SELECT var_samp(l_quantity) AS v FROM lineitem GROUP BY l_linenumber))")
def _(v):
    return rounded(T.covariance_sum(v.raw("lineitem"), "l_orderkey", "l_linenumber", "l_quantity"), ld_sum=3)


@query("agg32_relative_rate", "SELECT l_returnflag, round(avg(l_tax) / (SELECT avg(l_tax) FROM lineitem WHERE l_returnflag = 'N'), 9) AS relative FROM lineitem GROUP BY 1")
def _(v):
    from popspark.operators.stats import weighted_mean  # noqa: F401

    x = v.raw("lineitem")
    base = x.agg(F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_tax"))).alias("base"))
    return x.groupBy("l_returnflag").agg(F.avg("l_tax").alias("m")).crossJoin(F.broadcast(base)).select("l_returnflag", F.round(F.col("m") / F.col("base"), 9).alias("relative"))


@query("agg33_segment_gc", "SELECT doc_id, start, round((length(x) - length(translate(x, 'GCgc', '')))::DOUBLE / nullif(length(x) - length(translate(x, 'ACGTacgt', '')), 0), 9) AS gc FROM (SELECT doc_id, k AS start, substring(text, k + 1, 50) AS x FROM documents, unnest([0, 40, 90]) u(k) WHERE length(text) > k)")
def _(v):
    d = v.raw("documents").select(F.col("doc_id").cast("string").alias("chrom"), "text")
    chunks = d.select("chrom", F.posexplode(F.sequence(F.lit(0), F.length("text"), F.lit(64))).alias("k", "chunk_start"), "text").select("chrom", "chunk_start", F.expr("substring(text, chunk_start + 1, 64)").alias("seq")).filter("length(seq) > 0")
    segs = d.select("chrom", F.explode(F.array(F.lit(0), F.lit(40), F.lit(90))).alias("start"), F.length("text").alias("n")).filter("n > start").select("chrom", "start", F.least(F.col("start") + 50, F.col("n")).alias("end"))
    return tracks.segment_gc(segs, chunks, 64).select(F.col("chrom").cast("long").alias("doc_id"), "start", F.round("gc", 9).alias("gc"))


#: Segments of 50 characters from every 40th on, to the end of each text.
@query("agg33_segment_gc_whole", "SELECT doc_id, start, round((length(x) - length(translate(x, 'GCgc', '')))::DOUBLE / nullif(length(x) - length(translate(x, 'ACGTacgt', '')), 0), 9) AS gc FROM (SELECT doc_id, k::INT AS start, substring(text, k + 1, 50) AS x FROM documents, LATERAL unnest(range(0, length(text), 40)) u(k))")
def _(v):
    d = v.raw("documents").select(F.col("doc_id").cast("string").alias("chrom"), "text")
    # cut in one pass, so that the cost of a text grows with its length only
    cut = F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,512}"), F.lit(0))).alias("k", "seq")
    chunks = d.select("chrom", cut).select("chrom", (F.col("k") * 512).alias("chunk_start"), "seq")
    n = d.select("chrom", F.length("text").alias("n")).filter("n > 0")
    segs = n.select("chrom", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(40))).alias("start")).select("chrom", "start", F.least(F.col("start") + 50, F.col("n")).alias("end"))
    return tracks.segment_gc(segs, chunks, 512).select(F.col("chrom").cast("long").alias("doc_id"), "start", F.round("gc", 9).alias("gc"))


@query("agg34_centroids", 'SELECT floor((s + e) / 2.0 / 1000)::INT AS bin, feature, count(*) AS n, sum(e - s)::BIGINT AS bases FROM feats GROUP BY 1, 2')
def _(v):
    f = I.span(v.feats)
    return f.groupBy(F.floor(F.col("midpoint") / 1000).cast("int").alias("bin"), "feature").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


@query("agg35_histogram", "SELECT k::INT AS bin, k * 20.0::DOUBLE AS start, (k + 1) * 20.0::DOUBLE AS \"end\", (SELECT count(*) FROM events WHERE value >= k * 20 AND (value < (k + 1) * 20 OR (k = 9 AND value = 200))) AS n FROM unnest(range(0, 10)) u(k)")
def _(v):
    return T.histogram(v.raw("events"), "value", [20.0 * k for k in range(11)])


@query("agg35_log_histogram", "SELECT floor(log10(o_totalprice))::INT - 2 AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 100 AND o_totalprice < 1e6 GROUP BY 1")
def _(v):
    return T.histogram(v.raw("orders"), "o_totalprice", T.log_edges(100, 1e6, 4)).filter("n > 0").select("bin", "n")


@query("agg36_long_form", "SELECT p_partkey, 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(v):
    return T.long_form(v.raw("part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query("agg37_box", "SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1".replace("quantile_cont(p_retailprice, 0.25) AS q1", "round(quantile_cont(p_retailprice, 0.25), 6) AS q1").replace("quantile_cont(p_retailprice, 0.5) AS median", "round(quantile_cont(p_retailprice, 0.5), 6) AS median").replace("quantile_cont(p_retailprice, 0.75) AS q3", "round(quantile_cont(p_retailprice, 0.75), 6) AS q3"))
def _(v):
    return rounded(T.box(v.raw("part"), "p_brand", "p_retailprice"), q1=6, median=6, q3=6, mean=6)


# -- joins of windows ---------------------------------------------------------------------------------------------


@query("jon07_merge_tables", 'SELECT win.chrom, win.bin, round(pi, 9) AS pi, round(bases / (cov.e - cov.s), 9) AS fraction FROM win JOIN cov USING (chrom, bin)', *WIN, *COVERAGE[1:])
def _(v):
    c = I.coverage(I.tile(v.seqlens, WIDTH), v.feats.filter("status = 'F'")).select("chrom", "bin", "fraction")
    return rounded(windows(v).join(c, ["chrom", "bin"]).select("chrom", "bin", "pi", "fraction"), pi=9, fraction=9)


@query("jon08_put_back", "SELECT t.chrom, t.bin, CASE WHEN w.pi > 0.2 THEN round(w.pi, 9) END AS pi FROM tiles t LEFT JOIN win w USING (chrom, bin)", *WIN)
def _(v):
    kept = windows(v).filter("pi > 0.2").select("chrom", "bin", "pi")
    return rounded(I.tile(v.seqlens, WIDTH).select("chrom", "bin").join(kept, ["chrom", "bin"], "left"), pi=9)


@query("jon15_17_stacked", "SELECT l_returnflag AS feature, 'r' AS kind, round(avg(l_tax), 9) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'total', round(sum(l_tax), 4) FROM lineitem GROUP BY 1")
def _(v):
    g = v.raw("lineitem").groupBy(F.col("l_returnflag").alias("feature")).agg(F.round(F.avg("l_tax"), 9).alias("r"), F.round(F.sum("l_tax"), 4).alias("total"))
    return T.long_form(g, ["feature"], ["r", "total"], "kind")


# -- window functions ---------------------------------------------------------------------------------------------


@query("win03_midpoints", "SELECT chrom, pos, (rate + lead(rate) OVER (PARTITION BY chrom ORDER BY pos)) / 2 AS midpoint FROM hapmap")
def _(v):
    return T.midpoints(v.hapmap, "rate", "chrom", "pos").select("chrom", "pos", "midpoint")


@query("win04_lagged", "SELECT (b.bin - a.bin)::INT AS lag, round(avg((a.pi - b.pi) ** 2), 9) AS stat, avg(b.s - a.s)::DOUBLE AS distance, count(*) AS n FROM win a JOIN win b ON a.chrom = b.chrom AND b.bin - a.bin BETWEEN 1 AND 5 WHERE a.pi IS NOT NULL AND b.pi IS NOT NULL GROUP BY 1", *WIN)
def _(v):
    return rounded(D.lagged(windows(v), 5), stat=9)


@query("win05_blocks", "SELECT chrom, bin, ((row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1) // 7)::INT AS block FROM tiles", tiles(WIDTH))
def _(v):
    return D.blocks(I.tile(v.seqlens, WIDTH), 7).select("chrom", "bin", "block")


@query("win06_moving_blocks", "SELECT a.chrom, a.bin, b.bin::INT AS block FROM tiles a JOIN tiles b ON a.chrom = b.chrom AND a.bin BETWEEN b.bin AND b.bin + 3 JOIN (SELECT chrom, count(*) AS n FROM tiles GROUP BY 1) c ON c.chrom = a.chrom WHERE b.bin + 3 < n", tiles(WIDTH))
def _(v):
    return D.moving_blocks(I.tile(v.seqlens, WIDTH), 4).select("chrom", "bin", "block")


@query("win07_genome_coordinates", "SELECT chrom, pos, (pos + (substring(chrom, 4)::INT - 1) * (length + 10))::BIGINT AS genome_pos, round(pos / length, 9) AS chrom_frac FROM sites JOIN seqlens USING (chrom)")
def _(v):
    return rounded(D.genome_coordinates(v.sites.select("chrom", "pos"), v.seqlens, 10), chrom_frac=9)


@query("win08_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(v):
    return D.first_of(v.raw("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("win09_standardise", "SELECT chrom, bin, round(pi / avg(pi) OVER w, 9) AS ratio, round((pi - avg(pi) OVER w) / stddev_pop(pi) OVER w, 6) AS z FROM win WINDOW w AS (PARTITION BY chrom)", *WIN)
def _(v):
    return rounded(D.standardise(windows(v), "pi").select("chrom", "bin", "ratio", "z"), ratio=9, z=6)


SG = T.savitzky_golay_weights(5, 2)
MIRROR = """m AS (SELECT chrom, bin, y FROM b UNION ALL SELECT b.chrom, -b.bin, f.y - abs(b.y - f.y) FROM b JOIN b f ON f.chrom = b.chrom AND f.bin = 0 WHERE b.bin BETWEEN 1 AND {h}
UNION ALL SELECT b.chrom, 2 * n - b.bin, f.y + abs(b.y - f.y) FROM b JOIN (SELECT chrom, max(bin) AS n FROM b GROUP BY 1) z USING (chrom) JOIN b f ON f.chrom = b.chrom AND f.bin = n WHERE b.bin BETWEEN n - {h} AND n - 1)"""


def _smooth(weights):
    h = len(weights) // 2
    return f"SELECT chrom, bin, round({' + '.join(f'{c!r}::DOUBLE * a{k}' for k, c in enumerate(weights))}, 6) AS smooth FROM (SELECT *, " + ", ".join(f"{'lag' if k < h else 'lead'}(y, {abs(k - h)}) OVER w AS a{k}" for k in range(2 * h + 1)) + " FROM m WINDOW w AS (PARTITION BY chrom ORDER BY bin)) WHERE bin >= 0 AND a0 IS NOT NULL AND a" + str(2 * h) + " IS NOT NULL"


SERIES = "b AS (SELECT chrom, bin, coalesce(pi, 0) AS y FROM win)"


@query("win10_savitzky_golay", _smooth(SG), *WIN, SERIES, MIRROR.format(h=2))
def _(v):
    w = windows(v).select("chrom", "bin", F.coalesce("pi", F.lit(0.0)).alias("y"))
    return rounded(T.stencil(w, "y", SG).select("chrom", "bin", "smooth"), smooth=6)


@query("win11_gaussian", _smooth(T.gaussian_weights(1.0)), *WIN, SERIES, MIRROR.format(h=4))
def _(v):
    w = windows(v).select("chrom", "bin", F.coalesce("pi", F.lit(0.0)).alias("y"))
    return rounded(T.stencil(w, "y", T.gaussian_weights(1.0)).select("chrom", "bin", "smooth"), smooth=6)


@query(
    "win12_lowess",
    """SELECT "at", round(CASE WHEN abs(sw * sxx - sx * sx) > 1e-12 THEN (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) ELSE sy / sw END, 6) AS fit FROM (
SELECT "at", sum(w) AS sw, sum(w * c) AS sx, sum(w * c * c) AS sxx, sum(w * y) AS sy, sum(w * c * y) AS sxy FROM (
SELECT d."at", c, y, (CASE WHEN h > 0 THEN 1 - (d / h) ** 3 ELSE 1 END) ** 3 AS w FROM near d JOIN (SELECT "at", d AS h FROM near WHERE nth = k) h ON h."at" = d."at" WHERE d < h OR h = 0) GROUP BY 1)""",
    """near AS (SELECT *, row_number() OVER (PARTITION BY "at" ORDER BY d) AS nth FROM (
SELECT g::DOUBLE AS "at", p_size - g AS c, p_retailprice AS y, abs(p_size - g)::DOUBLE AS d, greatest(2, ceil(0.3 * n))::BIGINT AS k FROM part, unnest([5, 15, 25, 35, 45]) u(g), (SELECT count(*) AS n FROM part)))""",
)
def _(v):
    targets = v.spark.createDataFrame([(float(x),) for x in (5, 15, 25, 35, 45)], "at double")
    return rounded(T.lowess(v.raw("part").withColumn("x", F.col("p_size").cast("double")), targets, "x", "p_retailprice", 0.3), fit=6)


@query("win13_kernel_regression", "SELECT g::DOUBLE AS \"at\", round(sum(exp(-(((g - p_size) / 4.0) ** 2) / 2) * p_retailprice) / sum(exp(-(((g - p_size) / 4.0) ** 2) / 2)), 6) AS fit FROM part, unnest([5, 15, 25, 35, 45]) u(g) GROUP BY 1")
def _(v):
    targets = v.spark.createDataFrame([(float(x),) for x in (5, 15, 25, 35, 45)], "at double")
    return rounded(T.kernel_regression(v.raw("part"), targets, "p_size", "p_retailprice", 4.0), fit=6)


@query("win14_count_classes", "SELECT p_partkey, ((p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT)::INT AS class FROM part, (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)")
def _(v):
    return T.count_classes(v.raw("part"), "p_retailprice", 4).select("p_partkey", "class")


@query("win15_window_index", "SELECT chrom, bin, (row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1)::INT AS index_in_chrom, (row_number() OVER (ORDER BY chrom, bin) - 1)::BIGINT AS index FROM tiles", tiles(WIDTH))
def _(v):
    return D.window_index(I.tile(v.seqlens, WIDTH)).select("chrom", "bin", "index_in_chrom", "index")


@query("win16_softmax", "SELECT p_partkey, round(e / sum(e) OVER (PARTITION BY p_brand), 9) AS weight FROM (SELECT *, exp(p_size / 10.0::DOUBLE - max(p_size / 10.0::DOUBLE) OVER (PARTITION BY p_brand)) AS e FROM part)")
def _(v):
    p = v.raw("part").withColumn("x", F.col("p_size") / 10.0)
    return rounded(T.softmax(p, "x", ["p_brand"]).select("p_partkey", "weight"), weight=9)


@query("mod21_regression", "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(corr(y, x), 9) AS r, round(corr(y, x) ** 2, 9) AS r2, round(sqrt((1 - corr(y, x) ** 2) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)), 6) AS stderr FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)")
def _(v):
    return rounded(T.linear_regression(v.raw("lineitem"), "l_quantity", "l_extendedprice"), slope=6, intercept=4, r=9, r2=9, stderr=6)


@query("mod22_slope_after_burn_in", "SELECT user_id, round(regr_slope(y, g), 6) AS slope FROM (SELECT user_id, event_id // 1000 AS g, avg(value) AS y FROM events GROUP BY 1, 2) WHERE g >= 2 GROUP BY 1 HAVING count(*) > 1")
def _(v):
    e = v.raw("events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("at")).agg(F.avg("value").alias("y"))
    return rounded(T.slope_after(e, ["user_id"], "at", "y", 2), slope=6)


@query("mod23_cv_bins")
def _(v):
    return T.cv_bins(v.raw("lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "x", "y", [2, 5, 10, 25])


@query(
    "mod23_cv_contiguous",
    """SELECT nbins::INT AS nbins, round(avg(mse), 3) AS mse FROM (SELECT nbins, fold, sum(w * (ss - 2 * m * s + n * m * m)) / sum(w * n) AS mse FROM (
SELECT *, sum(n) OVER b - n AS w, (sum(s) OVER b - s) / nullif(sum(n) OVER b - n, 0) AS m FROM (
SELECT nbins, fold, floor((x - lo) / (hi - lo) * nbins) AS bin, sum(y) AS s, sum(y * y) AS ss, count(*) AS n FROM f, (SELECT min(x) AS lo, max(x) * 1.001::DOUBLE AS hi FROM f), unnest([2, 5, 10, 25]) u(nbins) GROUP BY 1, 2, 3)
WINDOW b AS (PARTITION BY nbins, bin)) WHERE w > 0 GROUP BY 1, 2) GROUP BY 1""",
    "f AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, ntile(5) OVER (ORDER BY l_orderkey, l_linenumber) AS fold FROM lineitem)",
)
def _(v):
    r = v.raw("lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), "l_orderkey", "l_linenumber")
    return rounded(T.cv_bins_contiguous(r, "x", "y", ["l_orderkey", "l_linenumber"], [2, 5, 10, 25]), mse=3)


@query("srt05_extremes", "SELECT chrom, bin, round(z, 6) AS z FROM (SELECT chrom, bin, (pi - avg(pi) OVER w) / stddev_pop(pi) OVER w AS z FROM win WINDOW w AS (PARTITION BY chrom)) WHERE abs(z) > 2", *WIN)
def _(v):
    return rounded(D.standardise(windows(v), "pi").filter("abs(z) > 2").select("chrom", "bin", "z"), z=6)


# -- resampling ---------------------------------------------------------------------------------------------------


@query("res01_02_block_bootstrap")
def _(v):
    w = D.window_pairs(v.sites_in(WIDTH), I.tile(v.seqlens, WIDTH), WIDTH)
    return B.bootstrap_pi(B.block_bootstrap(w, 5, 100, seed=1))


@query("res03_row_bootstrap")
def _(v):
    return B.row_bootstrap(v.raw("part").select("p_size", "p_retailprice"), 20, seed=2).groupBy("replicate").agg(F.regr_slope("p_retailprice", "p_size").alias("slope"), F.count("*").alias("n"))


@query("res03_drawn_rows", "SELECT r AS replicate, (SELECT count(*) FROM part) AS n, true AS repeats FROM range(1, 21) t(r)")
def _(v):
    """Draws with replacement by row number: as many rows in each replicate as there are, some more than once."""
    d = ordered.drawn(v.raw("part").select("p_partkey"), 20, seed=2).groupBy("replicate").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("d"))
    return d.select("replicate", "n", (F.col("d") < F.col("n")).alias("repeats"))


@query("res04_intervals", "SELECT round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper, round(2 * avg(value) - quantile_cont(value, 0.975), 6) AS pivot_lower, round(2 * avg(value) - quantile_cont(value, 0.025), 6) AS pivot_upper FROM events")
def _(v):
    e = v.raw("events")
    mean = e.agg(F.avg("value").alias("estimate"))
    return rounded(B.interval(e, "value", mean, 0.05).select("lower", "upper", "pivot_lower", "pivot_upper"), lower=9, upper=9, pivot_lower=6, pivot_upper=6)


@query("res05_bernoulli")
def _(v):
    return v.sites.sample(fraction=0.1, seed=3)


@query("res06_collect", "SELECT o_orderstatus AS code, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS fraction, min(o_totalprice) AS best FROM orders GROUP BY 1")
def _(v):
    return rounded(B.collect_runs(v.raw("orders"), "o_orderstatus", "o_totalprice"), fraction=9)


@query("agg22_ranked_runs", "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice)::INT AS place FROM orders WHERE o_orderstatus = 'F' QUALIFY place <= 10")
def _(v):
    return B.best_runs(v.raw("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


@query("srt04_best", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(v):
    return v.raw("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(25)
