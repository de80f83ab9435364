"""B maps, likelihood, fits and predictions (MOD) and the joins and aggregations around them."""

from pyspark.sql import functions as F

from popspark.operators import diversity as D, intervals as I, ordered, resample as B, stats as T
from popspark.plans import bmap as M, likelihood as L, substitution as S
from popspark.queries.interval_queries import SEGMENTS, segments
from popspark.queries.views import RECMAP, query, tiles
from popspark.queries.window_queries import KNOTS, NSITES, WIN, WIDTH, rounded, windows

WS, TS = [1e-6, 3e-6, 1e-5], [0.001, 0.01]
STEP = 4000
CASE = lambda c, xs: f"(CASE {c} " + " ".join(f"WHEN {i} THEN {x!r}::DOUBLE" for i, x in enumerate(xs)) + " END)"
MAP = (
    *SEGMENTS,
    KNOTS,
    f"ps AS (SELECT chrom, unnest(range(0, length, {STEP})) AS pos FROM seqlens UNION SELECT chrom, length - 1 FROM seqlens)",
    "points AS (SELECT t.chrom, t.pos, (CASE WHEN t.pos <= x0 THEN y0 WHEN t.pos >= xn THEN yn ELSE (SELECT y + (t.pos - x) * (y1 - y) / (x1 - x) FROM k1 WHERE k1.chrom = t.chrom AND t.pos >= x AND t.pos < x1) END) AS m FROM ps t JOIN k0 USING (chrom))",
    f"ts AS (SELECT ti, {CASE('ti', TS)} AS t FROM unnest([0, 1]) u(ti)), ws AS (SELECT wi, {CASE('wi', WS)} AS w FROM unnest([0, 1, 2]) u(wi))",
    """effects AS (SELECT p.chrom, p.pos, feature, ti, sum(-t * L / ((1-t)*(1-t)*rf*rf + (2*t*(1-t) + rate*L*(1-t)*(1-t))*rf + t*t + rate*L*t*(1-t))) AS x
FROM (SELECT p.chrom, p.pos, feature, rate, (s.e - s.s)::DOUBLE AS L, greatest(s.m0 - p.m, p.m - s.m1, 0) AS rf FROM points p JOIN segments s USING (chrom)) p, ts GROUP BY 1, 2, 3, 4)""",
    "bmap AS (SELECT chrom, pos, feature, wi, ti, w * x AS log_b FROM effects, ws)",
)
BINNED = (
    *MAP,
    f"""binned AS (SELECT chrom, wi, ti, feature, floor(mx / {2 * STEP})::INT AS bin, avg(my) AS log_b FROM (SELECT chrom, wi, ti, feature, (pos + lead(pos) OVER w) / 2.0 AS mx, (log_b + lead(log_b) OVER w) / 2 AS my FROM bmap WINDOW w AS (PARTITION BY chrom, wi, ti, feature ORDER BY pos)) WHERE mx IS NOT NULL GROUP BY 1, 2, 3, 4, 5)""",
    f"slopes AS (SELECT chrom, bin, ti, feature, -regr_slope(log_b, w) AS a FROM binned JOIN ws USING (wi) GROUP BY 1, 2, 3, 4)",
)
#: Example parameter sets: (theta_id, pi0, mu, weights by t for every feature).
THETA = [(0, 0.25, 1e-6, (0.5, 0.5)), (1, 0.3, 3e-6, (0.9, 0.1)), (2, 0.2, 1e-5, (0.2, 0.8))]
THETA_SQL = "theta AS (" + " UNION ALL ".join(f"SELECT {i} AS theta_id, {p!r}::DOUBLE AS pi0, {m!r}::DOUBLE AS mu, {j} AS ti, {w!r}::DOUBLE AS weight" for i, p, m, ws in THETA for j, w in enumerate(ws)) + ")"
WIDE = tuple(x.replace(f"// {WIDTH}", f"// {2 * STEP}") for x in (tiles(2 * STEP), NSITES, WIN[2]))
PREDICTED = (*BINNED, THETA_SQL, "predicted AS (SELECT theta_id, chrom, bin, exp(-mu * sum(weight * a)) AS b, pi0 * exp(-mu * sum(weight * a)) AS pi FROM slopes JOIN theta USING (ti) GROUP BY theta_id, pi0, mu, chrom, bin)")


def placed(v, step=STEP):
    """Positions and segments on one recombination map, which is built once for both."""
    m = ordered.kept(v.recmap)
    return M.positions(v.seqlens, m, step), segments(v, m)


def bmap(v):
    return M.classic_map(*placed(v), WS, TS)


def slopes(v):
    return M.collapse_w(M.bin_map(bmap(v), 2 * STEP), WS)


def wide_windows(v):
    return D.window_pairs(v.sites_in(2 * STEP), I.tile(v.seqlens, 2 * STEP), 2 * STEP)


def kept_windows(v):
    """For queries that read their windows more than once: sites are summed up once."""
    return ordered.kept(wide_windows(v))


def theta(v):
    features = [f"{x}" for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]
    rows = [(i, p, m, j, f, w) for i, p, m, ws in THETA for j, w in enumerate(ws) for f in features]
    return v.spark.createDataFrame(rows, "theta_id int, pi0 double, mu double, ti int, feature string, weight double")


def predicted(v):
    return L.predict(slopes(v), theta(v))


@query("mod01_segment_terms", f"""SELECT chrom, s AS start, ti, feature, round(-t * (e - s), 9) AS a, round((1-t)*(1-t), 9) AS b, round(2*t*(1-t) + rate*(e-s)*(1-t)*(1-t), 12) AS c, round(t*t + rate*(e-s)*t*(1-t), 12) AS d FROM segments, ts""", *MAP)
def _(v):
    x = M.classic_terms(segments(v), M.grid(v.spark, WS, TS)).select("chrom", "start", "ti", "feature", "a", "b", "c", "d")
    return rounded(x, a=9, b=9, c=12, d=12)


@query("mod02_classic_map", "SELECT chrom, pos, feature, wi, ti, round(log_b, 6) AS log_b FROM bmap", *MAP)
def _(v):
    return rounded(bmap(v), log_b=6)


@query("mod03_ratchet_terms")
def _(v):
    return M.ratchet_terms(segments(v), [1e-7, 1e-6], [1e-4, 1e-3], 1000.0)


@query("mod04_ratchet_map")
def _(v):
    return M.ratchet_map(*placed(v, 4 * STEP), [1e-7, 1e-6], [1e-4, 1e-3], 1000.0)


@query("mod05_rescaled_terms")
def _(v):
    s = M.rescaled(segments(v), bmap(v), 0, 1)
    return M.with_terms(s, [1e-7], [1e-3], 1000.0).select("chrom", "start", "end", "feature", "n_scale", "T", "V", "Vm")


@query("mod06_collapsed_w", "SELECT s.chrom, s.bin, s.ti, s.feature, round(a, 3) AS a, round(avg((exp(log_b) - exp(-w * a)) ** 2), 9) AS residual FROM slopes s JOIN binned b USING (chrom, bin, ti, feature) JOIN ws USING (wi) GROUP BY 1, 2, 3, 4, 5", *BINNED)
def _(v):
    return rounded(slopes(v), a=3, residual=9)


@query("mod07_predict", "SELECT theta_id, chrom, bin, round(b, 9) AS b, round(pi, 9) AS pi FROM predicted", *PREDICTED)
def _(v):
    return rounded(predicted(v), b=9, pi=9)


@query(
    "mod07_predict_on_grid",
    """SELECT theta_id, chrom, bin, round(exp(sum(x)), 9) AS b, round(pi0 * exp(sum(x)), 9) AS pi FROM (SELECT theta_id, pi0, b0.chrom, b0.bin, CASE WHEN mu * weight < 1e-6 THEN 0 WHEN mu * weight < 3e-6 THEN b0.log_b + (mu * weight - 1e-6) / (3e-6 - 1e-6) * (b1.log_b - b0.log_b)
WHEN mu * weight < 1e-5 THEN b1.log_b + (mu * weight - 3e-6) / (1e-5 - 3e-6) * (b2.log_b - b1.log_b) ELSE b2.log_b END AS x FROM binned b0 JOIN binned b1 USING (chrom, bin, ti, feature) JOIN binned b2 USING (chrom, bin, ti, feature) JOIN theta USING (ti) WHERE b0.wi = 0 AND b1.wi = 1 AND b2.wi = 2) GROUP BY theta_id, pi0, chrom, bin""",
    *BINNED,
    THETA_SQL,
)
def _(v):
    return rounded(L.predict_on_grid(M.bin_map(bmap(v), 2 * STEP), theta(v), WS), b=9, pi=9)


NLL = "nlls AS (SELECT theta_id, -sum(n_diff * ln(p.pi) + n_same * ln(1 - p.pi)) AS nll FROM predicted p JOIN win USING (chrom, bin) GROUP BY 1)"


@query("mod08_nll", "SELECT theta_id, round(nll, 2) AS nll FROM nlls", *PREDICTED, *WIDE, NLL)
def _(v):
    return rounded(L.negative_log_likelihood(predicted(v), wide_windows(v)), nll=2)


@query("mod09_profile_best", "SELECT theta_id, round(nll, 2) AS nll FROM nlls ORDER BY nll LIMIT 1", *PREDICTED, *WIDE, NLL)
def _(v):
    return rounded(L.best(L.negative_log_likelihood(predicted(v), wide_windows(v))), nll=2)


@query("agg27_nll_by_chrom", "SELECT theta_id, chrom, round(-sum(n_diff * ln(p.pi) + n_same * ln(1 - p.pi)), 2) AS nll FROM predicted p JOIN win USING (chrom, bin) GROUP BY 1, 2", *PREDICTED, *WIDE)
def _(v):
    return rounded(L.negative_log_likelihood(predicted(v), wide_windows(v), ["theta_id", "chrom"]), nll=2)


def fit(v, **kw):
    f = L.Fit(ordered.kept(slopes(v)), wide_windows(v), **{k: kw.pop(k) for k in ("group", "mu") if k in kw})
    t = f.table(v.spark, f.run(**kw))
    f.close()
    return t


@query("mod10_fit")
def _(v):
    return fit(v, starts=4)


@query("mod11_fit_fixed_mu")
def _(v):
    return fit(v, starts=4, mu=1e-6)


@query("mod12_residuals", "SELECT theta_id, chrom, bin, round(r, 9) AS resid, round((r - avg(r) OVER w) / stddev_pop(r) OVER w, 6) AS z FROM (SELECT theta_id, chrom, bin, w.pi - p.pi AS r FROM predicted p JOIN win w USING (chrom, bin) WHERE w.pi IS NOT NULL) WINDOW w AS (PARTITION BY theta_id, chrom)", *PREDICTED, *WIDE)
def _(v):
    r = L.residuals(L.predict(ordered.kept(slopes(v)), theta(v)), kept_windows(v)).select("theta_id", "chrom", "bin", "resid", "z")
    return rounded(r, resid=9, z=6)


def chromosome_fits(v):
    """Out-of-sample r by left-out chromosome, and the fits; the map is built once."""
    a, w = ordered.kept(slopes(v)), kept_windows(v)
    f = L.Fit(a, w, group="chrom")
    t = f.table(v.spark, f.run(starts=2, leave_out=True))
    f.close()
    return L.out_of_sample(t, a, w), t


@query("mod13_leave_one_chromosome_out")
def _(v):
    r, t = chromosome_fits(v)
    return r.join(F.broadcast(t.select("left_out", "converged", "iterations").distinct()), "left_out")


@query("mod13_average_r", "SELECT count(*) AS n, true AS is_correlation FROM win JOIN (SELECT DISTINCT chrom, bin FROM slopes) USING (chrom, bin) WHERE pi IS NOT NULL", *BINNED, *WIDE)
def _(v):
    one = L.average_r(chromosome_fits(v)[0])
    return one.select("n", F.col("r").between(-1, 1).alias("is_correlation"))


@query("mod14_block_jackknife")
def _(v):
    b, _ = L.jackknife(ordered.kept(slopes(v)), kept_windows(v), 4, moving=False)
    return b.select("left_out", "pi0", "mu", "nll", "converged", "r")


#: Windows with data, their number in the chromosome, and the windows of each chromosome.
NTH = "nth AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1 AS nth, count(*) OVER (PARTITION BY chrom) AS n FROM win)"


@query(
    "mod14_moving_blocks",
    """SELECT b.chrom, b."first", 2 AS size, count(*) FILTER (x.chrom IS NOT NULL) AS lost, any_value(t.total) - count(*) FILTER (n_same + n_diff > 0) AS retained, true AS converged
FROM (SELECT DISTINCT chrom, n, nth AS "first" FROM nth WHERE nth <= n - 2) b CROSS JOIN (SELECT count(*) AS total FROM nth WHERE n_same + n_diff > 0 AND n >= 2) t
LEFT JOIN nth x ON x.chrom = b.chrom AND greatest(0, x.nth - 1) = least(x.nth, x.n - 2) AND greatest(0, x.nth - 1) = b."first" GROUP BY 1, 2""",
    *WIDE,
    NTH,
)
def _(v):
    b, _ = L.jackknife(ordered.kept(slopes(v)), kept_windows(v), 2)
    return b.select("chrom", "first", "size", "lost", "retained", "converged")


@query("mod10_fit_against_grid", "SELECT theta_id, round(nll, 2) AS nll, true AS fit_is_lower FROM nlls", *PREDICTED, *WIDE, NLL)
def _(v):
    """The nll that the fitted parameters give by themselves, from the plain prediction, is no higher than that of any example set."""
    a, w = ordered.kept(slopes(v)), kept_windows(v)
    f = L.Fit(a, w)
    t = f.table(v.spark, f.run(starts=64, survivors=2)).filter("converged")
    f.close()
    fitted = L.negative_log_likelihood(L.predict(a, t), w).agg(F.min("nll").alias("fitted"))
    grid = L.negative_log_likelihood(L.predict(a, theta(v)), w)
    return rounded(grid.crossJoin(F.broadcast(fitted)).select("theta_id", "nll", (F.col("fitted") <= F.col("nll")).alias("fit_is_lower")), nll=2)


@query("mod15_jackknife_error", "SELECT l_returnflag, round(avg(l_tax), 9) AS mean, round(sqrt((count(*) - 1) * var_pop(l_tax)), 4) AS stderr, count(*) AS n FROM lineitem GROUP BY 1")
def _(v):
    return rounded(B.jackknife_error(v.raw("lineitem"), ["l_returnflag"], "l_tax"), mean=9, stderr=4)


@query("mod16_parametric_bootstrap")
def _(v):
    se = theta(v).select("theta_id", "ti", "feature", F.lit(0.05).alias("se")).join(segments(v).select("feature").distinct(), "feature", "left_semi")
    d = L.parametric_bootstrap(theta(v), se, 200, 7)
    return L.average_selection(d.withColumn("theta_id", F.concat_ws(":", F.col("theta_id").cast("string"), F.col("replicate").cast("string"))), TS)


def predictions(v):
    return S.substitution_table(segments(v), theta(v).filter("theta_id = 1"), TS, 1000.0)


@query("mod17_substitution_table")
def _(v):
    return predictions(v)


#: The summaries below run on a plain table of the same shape, so that SQL can check them.
PRED = "pred AS (SELECT f.chrom, f.s, f.e, feature, (e - s) / 1000.0::DOUBLE AS R, (e - s) / 7.0::DOUBLE AS V, 1.0::DOUBLE / (e - s) AS r1, -(e - s) / 3.0::DOUBLE AS load FROM feats f)"


def plain_predictions(v):
    n = F.col("end") - F.col("start")
    return v.feats.select("chrom", "start", "end", "feature", (n / 1000).alias("R_seg"), (n / 7).alias("V"), (n / 7).alias("Vm"), (1 / n).alias("rr"), (-n / 3).alias("load"))


@query(
    "mod18_feature_summary",
    "SELECT feature, round(avg(r1), 9) AS mean_r, round(sum(r1 * (e - s)) / sum(e - s), 9) AS r_weighted, round(avg(r1) / 0.01 * 100, 6) AS r_mu, round(sum(V), 3) AS V, round(sum(load), 3) AS load FROM pred GROUP BY 1",
    PRED,
)
def _(v):
    g = S.feature_summary(plain_predictions(v).withColumnRenamed("rr", "r"), 0.01)
    return rounded(g.select("feature", F.col("r").alias("mean_r"), "r_weighted", "r_mu", "V", "load"), mean_r=9, r_weighted=9, r_mu=6, V=3, load=3)


@query("mod18_predicted_summary")
def _(v):
    return S.feature_summary(predictions(v), THETA[1][2])


@query("mod19_window_rates", f"SELECT chrom, floor((s + e) / 2.0 / {WIDTH})::INT AS bin, round(avg(r1), 9) AS r, count(*) AS n FROM pred GROUP BY 1, 2", PRED)
def _(v):
    return rounded(S.window_rates(plain_predictions(v).withColumnRenamed("rr", "r"), WIDTH), r=9)


@query("mod20_likelihood_ratio", "SELECT theta_id, round(nll, 2) AS nll, round(c, 2) AS nll_constant, round(2 * (c - nll), 2) AS ratio FROM nlls, (SELECT -(d * ln(d / (s + d)) + s * ln(1 - d / (s + d))) AS c FROM (SELECT sum(n_diff) AS d, sum(n_same) AS s FROM win))", *PREDICTED, *WIDE, NLL)
def _(v):
    return rounded(L.likelihood_ratio(predicted(v), kept_windows(v)), nll=2, nll_constant=2, ratio=2)


@query("agg31_average_selection", f"SELECT theta_id, feature, round(sum({CASE('ti', TS)} * weight), 9) AS mean_t FROM theta, (SELECT DISTINCT feature FROM segments) GROUP BY 1, 2", *SEGMENTS, THETA_SQL)
def _(v):
    t = theta(v).join(F.broadcast(segments(v).select("feature").distinct()), "feature", "left_semi")
    return rounded(L.average_selection(t, TS), mean_t=9)


@query("agg10_binned_map", "SELECT chrom, wi, ti, feature, bin, round(log_b, 6) AS log_b FROM binned", *BINNED)
def _(v):
    return rounded(M.bin_map(bmap(v), 2 * STEP), log_b=6)


@query("flt18_one_cell", "SELECT chrom, pos, feature, round(exp(log_b), 9) AS b FROM bmap WHERE wi = 1 AND ti = 0", *MAP)
def _(v):
    return rounded(M.one_cell(bmap(v), 1, 0), b=9)


@query(
    "jon04_b_at_windows",
    f"""SELECT t.chrom, t.bin, b.wi, b.ti, b.feature, round(CASE WHEN t.s >= m.last THEN m.ylast ELSE b.log_b + (t.s - b.pos)::DOUBLE / (b.p1 - b.pos) * (b.y1 - b.log_b) END, 6) AS log_b FROM tiles t JOIN (SELECT *, lead(pos) OVER w AS p1, lead(log_b) OVER w AS y1 FROM bmap WINDOW w AS (PARTITION BY chrom, wi, ti, feature ORDER BY pos)) b
ON b.chrom = t.chrom AND t.s >= b.pos AND t.s < coalesce(b.p1, 1e18) JOIN (SELECT chrom, wi, ti, feature, max(pos) AS last, arg_max(log_b, pos) AS ylast FROM bmap GROUP BY 1, 2, 3, 4) m ON m.chrom = b.chrom AND m.wi = b.wi AND m.ti = b.ti AND m.feature = b.feature""",
    *MAP,
    tiles(3000),
)
def _(v):
    p = I.tile(v.seqlens, 3000).select("chrom", "bin", F.col("start").alias("pos"))
    return rounded(M.b_at(p, bmap(v)).drop("pos"), log_b=6)


@query(
    "jon10_map_against_pi",
    "SELECT chrom, bin, ti, round(exp(sum(log_b)), 9) AS b, round(any_value(pi), 9) AS pi FROM binned JOIN win USING (chrom, bin) WHERE wi = 0 GROUP BY 1, 2, 3",
    *BINNED,
    *WIDE,
)
def _(v):
    b = M.bin_map(bmap(v), 2 * STEP).filter("wi = 0").groupBy("chrom", "bin", "ti").agg(F.exp(F.sum("log_b")).alias("b"))
    return rounded(b.join(wide_windows(v).select("chrom", "bin", "pi"), ["chrom", "bin"]), b=9, pi=9)


@query("jon11_distances", "SELECT p.chrom, p.pos, count(*) AS n, round(1e6 * sum(greatest(s.m0 - p.m, p.m - s.m1, 0)), 3) AS distance FROM points p JOIN segments s USING (chrom) GROUP BY 1, 2", *MAP)
def _(v):
    d = M.distances(*placed(v))
    return d.select("chrom", "pos", "n", F.round(F.col("distance") * 1e6, 3).alias("distance"))


@query("jon13_windows_by_theta", "SELECT theta_id, count(*) AS n, round(sum(n_diff), 3) AS n_diff FROM win, (SELECT DISTINCT theta_id FROM theta) GROUP BY 1", *WIDE, THETA_SQL)
def _(v):
    x = wide_windows(v).crossJoin(F.broadcast(theta(v).select("theta_id").distinct()))
    return x.groupBy("theta_id").agg(F.count("*").alias("n"), F.round(F.sum("n_diff"), 3).alias("n_diff"))


@query("jon14_merged_parts", "SELECT chrom, count(*) AS n, count(DISTINCT feature) AS features FROM segments GROUP BY 1", *SEGMENTS)
def _(v):
    from popspark.operators.tracks import merge_parts

    parts = [segments(v).filter(F.col("chrom") == c) for c in ("chr1", "chr2")] + [segments(v).filter(~F.col("chrom").isin("chr1", "chr2"))]
    return merge_parts(*parts).groupBy("chrom").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("features"))


@query("mod24_on_step", "SELECT chrom, pos, round(ln(CASE WHEN pos <= x0 THEN y0 WHEN pos >= xn THEN yn ELSE (SELECT y + (p.pos - x) * (y1 - y) / (x1 - x) FROM k1 WHERE k1.chrom = p.chrom AND p.pos >= x AND p.pos < x1) END), 9) AS log_b FROM (SELECT chrom, unnest(range(0, length, 700)) AS pos FROM seqlens) p JOIN k0 USING (chrom)", KNOTS.replace("SELECT chrom, e AS x, c1 AS y FROM recmap", "SELECT chrom, pos AS x, (rate + 1) / 10 AS y FROM hapmap"))
def _(v):
    e = v.hapmap.select("chrom", "pos", ((F.col("rate") + 1) / 10).alias("b"), F.lit(0).alias("run"))
    return rounded(M.on_step(e, v.seqlens, 700, ["run"]).select("chrom", "pos", "log_b"), log_b=9)


@query("mod25_runs_against_truth", "SELECT o_orderpriority, count(*) AS n, round(avg(abs(1 - o_totalprice / c_acctbal)), 6) AS rel_error FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 100 GROUP BY 1")
def _(v):
    j = v.raw("orders").join(v.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).filter("c_acctbal > 100")
    e = T.errors(j, ["o_orderpriority"], "c_acctbal", ["o_totalprice"])
    n = j.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return e.join(n, "o_orderpriority").select("o_orderpriority", "n", F.round("o_totalprice_relerror", 6).alias("rel_error"))


@query(
    "mod26_validate_map",
    "SELECT t.chrom, count(*) AS n, round(1e6 * sqrt(avg((m - c) ** 2)), 6) AS rmse FROM (SELECT t.chrom, c1 AS c, (CASE WHEN t.e + 7 <= x0 THEN y0 WHEN t.e + 7 >= xn THEN yn ELSE (SELECT y + (t.e + 7 - x) * (y1 - y) / (x1 - x) FROM k1 WHERE k1.chrom = t.chrom AND t.e + 7 >= x AND t.e + 7 < x1) END) AS m FROM recmap t JOIN k0 USING (chrom)) t GROUP BY 1",
    RECMAP,
    KNOTS,
)
def _(v):
    from popspark.operators import genmap

    p = v.recmap.select("chrom", (F.col("end") + 7).alias("pos"), F.col("cum_end").alias("c"))
    d = genmap.position(p, v.recmap)
    return d.groupBy("chrom").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("map_pos") - F.col("c"), F.lit(2)))) * 1e6, 6).alias("rmse"))
