"""Tiles of positions and segments, interval algebra within genes, rescaling by a fit, and readers in byte ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.operators import intervals as I
from popspark.plans import bmap as M
from popspark.sources import text


@pytest.fixture(scope="module")
def genome(spark):
    rng = random.Random(1)
    points = [(c, p, p * 1e-4) for c, n in (("a", 90), ("b", 13)) for p in range(0, n * 100, 100)]
    segments = [(c, s, s + 40, rng.choice("fg"), 1e-6, s * 1e-4, (s + 40) * 1e-4) for c, n in (("a", 70), ("b", 5)) for s in range(7, n * 120, 120)]
    return (
        points, segments, spark.createDataFrame(points, "chrom string, pos long, map_pos double").cache(),
        spark.createDataFrame(segments, "chrom string, start long, end long, feature string, rate double, map_start double, map_end double").cache(),
    )


def exact(points, segments, w, t):
    out: dict = {}
    for c, p, m in points:
        for d, s, e, f, r, m0, m1 in segments:
            if c == d:
                rf, n = max(m0 - m, m - m1, 0), e - s
                x = -t * n / ((1 - t) ** 2 * rf * rf + (2 * t * (1 - t) + r * n * (1 - t) ** 2) * rf + t * t + r * n * t * (1 - t))
                out[c, p, f] = out.get((c, p, f), 0) + w * x
    return out


@pytest.mark.parametrize("tile", [(1, 1), (7, 10), (1000, 1000)])
def test_maps_do_not_depend_on_tiles(genome, tile):
    points, segments, p, s = genome
    got = {(r["chrom"], r["pos"], r["feature"]): r["log_b"] for r in M.classic_map(p, s, [1e-6], [0.01], tile).collect()}
    assert got == pytest.approx(exact(points, segments, 1e-6, 0.01), rel=1e-9)


def test_reach_stays_within_its_bound(genome):
    points, segments, p, s = genome
    want = exact(points, segments, 1e-6, 0.01)
    near = {(r["chrom"], r["pos"], r["feature"]): r["log_b"] for r in M.classic_map(p, s, [1e-6], [0.01], (5, 5), reach=0.1).collect()}
    bound = {(r["chrom"], r["pos"], r["feature"]): r["bound"] for r in M.left_out(p, s, [1e-6], [0.01], 0.1, (5, 5)).collect()}
    assert set(bound) == set(want) and any(abs(near.get(k, 0) - v) > 0 for k, v in want.items())
    for k, v in want.items():
        assert -1e-12 <= near.get(k, 0.0) - v <= bound[k] * (1 + 1e-9) + 1e-12
    assert all(r["bound"] == 0 for r in M.left_out(p, s, [1e-6], [0.01], 1e9, (5, 5)).collect())


def test_tasks_follow_the_input(spark, genome):
    _, _, p, s = genome
    keys = {tile: M._tiles(p, s, tile)[2].count() for tile in ((9, 7), (90, 70))}
    assert keys[9, 7] > 20 * keys[90, 70]


def test_ratchet_map_by_published_sum(genome):
    """log B is the sum over segments of -V / 2 (1 / (1 - (1 - Vm / V)(1 - rf)))^2, with V and Vm from the solver."""
    points, segments, p, s = genome
    w, t, n = 1e-6, 1e-3, 1000.0
    got = {(r["chrom"], r["pos"], r["feature"]): r["log_b"] for r in M.ratchet_map(p, s, [w], [t], n, (9, 9)).collect()}
    want: dict = {}
    for c, at, m in points:
        for d, a, e, f, r, m0, m1 in segments:
            if c == d:
                _, v, vm = (float(x[0]) for x in M.solve_ratchet(w, t, [float(e - a)], r, n))
                q = 1 / (1 - (1 - vm / v) * (1 - min(1.0, max(m0 - m, m - m1, 0))))
                want[c, at, f] = want.get((c, at, f), 0) - v / 2 * q * q
    assert got == pytest.approx(want, rel=1e-9)


def test_ratchet_terms_solve_their_equations(genome):
    *_, s = genome
    got = M.with_terms(s, [1e-7, 1e-6], [1e-4, 1e-3], 1000.0).collect()
    assert len(got) == 4 * s.count()
    for r in got:
        mu, sh = (1e-7, 1e-6)[r["wi"]], (1e-4, 1e-3)[r["ti"]]
        u = 2 * (r["end"] - r["start"]) * mu
        assert r["Vm"] == pytest.approx(u * sh * sh)
        if math.isinf(r["T"]):
            assert r["V"] == pytest.approx(u * sh)
            continue
        assert r["V"] == pytest.approx(u * sh - 2 * sh / r["T"])
        z, m = 1 - r["Vm"] / r["V"], (r["end"] - r["start"]) * r["rate"]
        ne = 1000.0 * math.exp(-r["V"] / 2 * -2 / ((z - 1) * (2 + (m - 2) * z)))
        assert math.expm1(4 * sh * ne) / (2 * u * sh * ne) == pytest.approx(r["T"], rel=1e-6)


def test_rescaling_by_a_fit(spark, genome):
    *_, s = genome
    windows = spark.createDataFrame([(c, b, b * 1000, b * 1000 + 1000) for c in "ab" for b in range(9)], "chrom string, bin int, start long, end long")
    b = lambda k: 0.3 + 0.05 * k
    predicted = spark.createDataFrame([(c, k, b(k)) for c in "ab" for k in range(9)], "chrom string, bin int, b double")
    got = M.rescaled_by_fit(s, predicted, windows).collect()
    assert len(got) == s.count()
    for r in got:
        at = (r["start"] + r["end"]) / 2
        assert r["n_scale"] == pytest.approx(np.interp(at, [k * 1000 + 500 for k in range(9)], [b(k) for k in range(9)]))
    terms = {(r["chrom"], r["start"]): r for r in M.with_terms(M.rescaled_by_fit(s, predicted, windows), [1e-6], [1e-3], 1000.0).collect()}
    for r in got[:20]:
        t, v, vm = M.solve_ratchet(1e-6, 1e-3, [float(r["end"] - r["start"])], r["rate"], 1000.0 * r["n_scale"])
        row = terms[r["chrom"], r["start"]]
        assert (row["T"], row["V"], row["Vm"]) == pytest.approx((float(t[0]), float(v[0]), float(vm[0])))
    for bad in (predicted.withColumn("b", F.col("b") + 0.7), predicted.withColumn("b", F.col("b") - 0.3), predicted.filter("chrom = 'a'")):
        with pytest.raises(Exception, match="B outside"):
            M.rescaled_by_fit(s, bad, windows).collect()


def test_introns_and_label_sets(spark):
    def table(rows):
        return spark.createDataFrame(rows, "chrom string, start long, end long, gene string")

    genes = table([("a", 0, 100, "g"), ("a", 40, 90, "g"), ("a", 50, 160, "h"), ("b", 5, 9, "i")])
    exons, utrs = table([("a", 10, 20, "g"), ("a", 60, 70, "h"), ("a", 150, 200, "h")]), table([("a", 95, 100, "g"), ("b", 0, 20, "i")])
    rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert rows(I.introns(genes, exons, utrs, by="gene"), "gene", "start", "end") == [("g", 0, 10), ("g", 20, 95), ("h", 50, 60), ("h", 70, 150)]
    assert rows(I.introns(genes, exons, utrs), "start", "end") == [(0, 10), (20, 60), (70, 95), (100, 150)]
    own = I.introns(genes, exons, by="gene")
    assert rows(own.filter("gene = 'i'"), "start", "end") == [(5, 9)]
    assert rows(I.conservative(I.introns(genes, exons, utrs), 20), "start", "end") == [(120, 130)]
    sparse = I.label_set({"exon": exons, "intron": I.introns(genes, exons, utrs)})
    assert rows(sparse, "start", "end", "feature") == [(0, 10, "intron"), (10, 20, "exon"), (20, 60, "intron"), (60, 70, "exon"), (70, 95, "intron"), (100, 150, "intron"), (150, 200, "exon")]
    lengths = spark.createDataFrame([("a", 210), ("b", 30)], "chrom string, length long")
    full = I.label_set({"exon": exons, "intron": I.introns(genes, exons, utrs)}, lengths)
    assert rows(full.filter("feature = 'other'"), "chrom", "start", "end") == [("a", 95, 100), ("a", 200, 210), ("b", 0, 30)]


def test_one_sequence_file_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    records = [(f"chr{k} of {k}", "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate((5, 9000, 0, 61, 60, 14_000, 1))]
    for name in ("one.fa", "two.fa"):
        with open(tmp_path / name, "w") as f:
            for head, seq in records:
                f.write(f">{name}-{head}\n" + "".join(f"{seq[i : i + 60]}\n" for i in range(0, len(seq), 60)) + ("\n" if len(seq) == 61 else ""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = text.fasta(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        got = sorted(map(tuple, df.collect()))
        whole = {r["name"]: r["seq"] for r in text.sequences(df).collect()}
        heads = {r["name"] for r in text.fasta(spark, str(tmp_path / "one.fa"), True).select("name").distinct().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((f"{name}-{head.split()[0]}", i, seq[i : i + 60]) for name in ("one.fa", "two.fa") for head, seq in records for i in range(0, len(seq), 60))
    assert got == want and whole["two.fa-chr5"] == records[5][1]
    assert heads == {f"one.fa-{h}" for h, s in records if s}


MODEL = """ALPHABET: A C G T
ORDER: 0
SUBST_MOD: HKY85
TRAINING_LNL: -806355.998749
BACKGROUND: 0.25 0.25 0.2 0.3
RATE_MAT:
  -0.9    0.1    0.6    0.2
   0.1   -1.0    0.1    0.8
   0.7    0.1   -1.0    0.2
   0.1    0.6    0.2   -0.9
TREE: (pon:0.5,((hg:0.25,(pan1:0.125,pan2:1e-2):0.75):2,gor:0.375):1.5);
"""


def test_model_files(spark, tmp_path):
    (tmp_path / "chr13.CDS.mod").write_text(MODEL)
    path = str(tmp_path)
    settings = {r["key"]: r["value"] for r in text.model_settings(spark, path).collect()}
    assert settings == {"ALPHABET": "A C G T", "ORDER": "0", "SUBST_MOD": "HKY85", "TRAINING_LNL": "-806355.998749", "BACKGROUND": "0.25 0.25 0.2 0.3"}
    rates = {(r["from"], r["to"]): r["rate"] for r in text.rate_matrix(spark, path).collect()}
    assert len(rates) == 16 and rates["A", "G"] == 0.6 and rates["G", "A"] == 0.7 and rates["T", "T"] == -0.9
    tree = {r["node"]: r for r in text.model_trees(spark, path).collect()}
    name = {r["name"]: r["node"] for r in tree.values() if r["name"]}
    up = lambda n: [n] + (up(tree[n]["parent"]) if tree[n]["parent"] is not None else [])
    assert len(tree) == 9 and set(name) == {"pon", "hg", "pan1", "pan2", "gor"}
    assert [tree[n]["length"] for n in up(name["pan2"])] == [0.01, 0.75, 2.0, 1.5, None]
    assert [tree[n]["length"] for n in up(name["pon"])] == [0.5, None] and up(name["gor"])[1] == up(name["hg"])[2]
    assert {(r["chrom"], r["feature"], r["species"], r["length"]) for r in text.branch_lengths(spark, path).collect()} == {("chr13", "CDS", s, x) for s, x in (("pon", 0.5), ("hg", 0.25), ("pan1", 0.125), ("pan2", 0.01), ("gor", 0.375))}
    one = spark.createDataFrame([("((a,b)inner,c:3)root;",), ("",), (None,)], "t string").select(text.parse_tree(F.col("t")).alias("n")).collect()
    assert [(n["node"], n["parent"], n["name"], n["length"]) for n in one[0]["n"]] == [(0, None, "root", None), (1, 0, "inner", None), (2, 1, "a", None), (3, 1, "b", None), (4, 0, "c", 3.0)]
    assert one[1]["n"] == [] and one[2]["n"] is None
