"""Readers and writers on small literal files."""

import gzip

from pyspark.sql import functions as F

from popspark.sources import sinks, tables as B, text as X


def put(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
    return str(p)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_tables(spark, tmp_path):
    n = B.seqlens(spark, put(tmp_path, "len.tsv", "#c\nchr1\t100\nchr2\t50\nchrX\t9\n"), ["chrX"])
    assert rows(n) == [("chr1", 100), ("chr2", 50)]
    bed = put(tmp_path, "a.bed.gz", "chr1\t1\t5\texon\nchr3\t2\t4\tx\nchr1\t7\t7\ty\n")
    assert rows(B.bed3(spark, bed, n)) == [("chr1", 1, 5), ("chr1", 7, 7)]
    assert rows(B.annotation(spark, bed, n)) == [("chr1", 1, 5, "exon")]
    assert rows(B.annotation(spark, put(tmp_path, "b.bed", "chr1\t1\t5\n"))) == [("chr1", 1, 5, "undefined")]
    assert rows(B.unknown_chromosomes(B.bed3(spark, bed), n)) == [("chr3",)]
    assert rows(B.coverage(spark, put(tmp_path, "c.tsv", "chr1\t0\t10\t2\t5\t10\t0.5\n"))) == [("chr1", 0, 10, 2, 5, 10, 0.5)]


def test_maps(spark, tmp_path):
    n = spark.createDataFrame([("chr1", 30)], "chrom string, length long")
    h = B.hapmap(spark, put(tmp_path, "h.txt", "chrom\tpos\trate\tcum\nchr1\t5\t1.5\t0\nchr1\t9\t2\t0.1\n"))
    assert rows(h, "chrom", "pos", "rate") == [("chr1", 5, 1.5), ("chr1", 9, 2.0)]
    m = B.interval_map(spark, put(tmp_path, "i.bed", "chr1\t0\t10\t1.0\t0\nchr1\t10\t30\t2.0\t1\n"))
    assert rows(B.covers_all(m, n)) == [("chr1", True)] and rows(B.covers_all(m.filter("start = 0"), n)) == [("chr1", False)]
    assert rows(B.intervals_to_markers(m), "pos") == [(0,), (10,)]
    c = B.cumulative_map(spark, put(tmp_path, "c.txt", "chr1\t5\t0.1\nchr1\t9\t0.3\n"), n)
    assert rows(c) == [("chr1", 0, 0.0), ("chr1", 5, 0.1), ("chr1", 9, 0.3), ("chr1", 30, 0.3)]
    put(tmp_path, "maps/aa_chr2.txt", "pos\trate\tcum\n7\t1\t0\n")
    assert rows(B.maps_by_file(spark, str(tmp_path / "maps")), "chrom", "pos") == [("chr2", 7)]


def test_gff(spark, tmp_path):
    g = put(tmp_path, "g.gff3", "##gff\nchr1\ts\tgene\t11\t40\t.\t+\t.\tID=g1;Name=A\nchr1\ts\tmRNA\t11\t40\t.\t+\t.\tID=t1;Parent=g1;\nchr1\ts\texon\t11\t20\t.\t+\t.\tID=e1;Parent=t1\nchr1\ts\texon\t31\t40\t.\t+\t.\tID=e2;Parent=t1\n")
    r = B.gff(spark, g, ["gene", "exon"], {"exon": "ex"})
    assert rows(r, "feature", "start", "end") == [("ex", 10, 20), ("ex", 30, 40), ("gene", 10, 40)]
    assert rows(B.gene_locations(B.gff(spark, g)), "gene", "start", "end", "exon_bases") == [("g1", 10, 40, 20)]


def test_tracks(spark, tmp_path):
    assert rows(B.conserved(spark, put(tmp_path, "p.tsv", "chr1\t1\t3\tlod=3\t500\n"))) == [("chr1", 1, 3, 0.5)]
    s = put(tmp_path, "s.bed", "chr1\t1\t3\t2\t1.5\t9.0\n")
    assert rows(B.score_bed(spark, s)) == [("chr1", 1, 3, 9.0)] and rows(B.score_bed(spark, s, "mean")) == [("chr1", 1, 3, 1.5)]
    assert rows(B.bedgraph(spark, put(tmp_path, "t.bg", "chr1\t1\t3\t2.5\nchr1\t3\t4\tNaN\n"))) == [("chr1", 1, 3, 2.5)]
    assert rows(B.centromeres(spark, put(tmp_path, "y.txt", "chr1\t5\t9\tp11\tacen\nchr1\t9\t12\tq11\tacen\nchr1\t12\t20\tq12\tgneg\n"))) == [("chr1", [5, 9, 12])]


def test_counts(spark, tmp_path):
    p = put(tmp_path, "k.tsv", "#pop=yri;n=3\nchr1\t4\t10\t3\n")
    assert rows(B.counts(spark, p)) == [("chr1", 4, 7, 3)]
    assert B.metadata(spark, p).first()["params"] == {"pop": "yri", "n": "3"}
    out = str(tmp_path / "out")
    sinks.write_counts(B.counts(spark, p), out, {"pop": "yri"})
    assert rows(B.counts(spark, out)) == [("chr1", 4, 7, 3)]
    sinks.write_by_chromosome(B.counts(spark, p), str(tmp_path / "dir"))
    assert rows(B.counts_dir(spark, str(tmp_path / "dir")).filter("chrom = 'chr1'"), "pos", "n_ref") == [(4, 7)]


def test_simulation_files(spark, tmp_path):
    put(tmp_path, "ext/mu1e-8_s0.1/chr1.bkgd", "900 10\n800 5\n")
    got = rows(B.external_maps(spark, str(tmp_path / "ext" / "*" / "*")), "chrom", "mu", "s", "pos", "b")
    assert got == [("chr1", 1e-8, 0.1, 10, 0.9), ("chr1", 1e-8, 0.1, 15, 0.8)]
    put(tmp_path, "runs/mu__1e-8/a_rep1_seed2.sub.tsv", "#mu=1e-8;sh=0.1\nchr1\t5\t0.1\tm1\t0.5\nchr1\t5\t0.1\tm1\t0.5\n")
    r = B.substitutions(spark, str(tmp_path / "runs" / "*"))
    assert rows(B.event_counts(r, ["mu"])) == [("1e-8", 0.1, 5, 2)]
    assert B.path_params(B.files(spark, str(tmp_path / "runs"), ".sub.tsv")).first()["params"] == {"mu": "1e-8", "rep": "1", "seed": "2"}
    spark.range(1).write.parquet(str(tmp_path / "fits/pop=yri/window=100"))
    assert rows(B.fits_tree(spark, str(tmp_path / "fits")), "pop", "window") == [("yri", 100)]
    assert rows(B.id_list(spark, put(tmp_path, "ids.txt", "a\n\nb\n"))) == [("a",), ("b",)]
    assert rows(B.populations(spark, put(tmp_path, "pops.txt", "a\tyri\nb\tceu\n"), "yri")) == [("a",)]


def test_fasta(spark, tmp_path):
    f = X.fasta(spark, put(tmp_path, "x.fa", ">s1 desc\nACGT\nNNa\n>s2\nGG\n"))
    assert rows(f) == [("s1", 0, "ACGT"), ("s1", 4, "NNa"), ("s2", 0, "GG")]
    assert rows(X.sequences(f)) == [("s1", "ACGTNNa"), ("s2", "GG")]
    from popspark.operators.tracks import masked_runs

    assert rows(masked_runs(f.withColumnRenamed("name", "chrom"))) == [("s1", 4, 7)]
    h = X.cds_headers(spark.createDataFrame([("g|t|chr1|3|9",)], "name string"))
    assert rows(h, "gene", "tx", "chrom", "start", "end") == [("g", "t", "chr1", 3, 9)]
    a = X.alignment_regions(spark.createDataFrame([("hg38.chr1 chr1:3-9+",)], "name string"))
    assert rows(a, "region.start", "region.strand") == [(3, "+")]


def test_models(spark, tmp_path):
    put(tmp_path, "m/chr13.CDS.mod", "ALPHABET: A C G T\nTREE: ((hg38:0.01,panTro4:0.02):0.005,ponAbe2:0.03);\n")
    got = rows(X.branch_lengths(spark, str(tmp_path / "m")))
    assert got == [("chr13", "CDS", "hg38", 0.01), ("chr13", "CDS", "panTro4", 0.02), ("chr13", "CDS", "ponAbe2", 0.03)]


def test_genotypes(spark, tmp_path):
    v = put(tmp_path, "g.vcf", "##contig=<ID=chr1,length=100>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nchr1\t5\t.\tA\tG\t60\tPASS\t.\tGT:GQ\t0/1:40\t1|1:50\nchr1\t6\t.\tA\tC\t20\tPASS\t.\tGT:RGQ\t0/0:40\t0/1:50\nchr1\t7\t.\tA\tC\t60\tlow\t.\tGT:GQ\t0/0:40\t0/1:50\n")
    assert rows(X.contigs(spark, v)) == [("chr1", 100)]
    g = X.genotypes(spark, v)
    c = X.allele_counts(g)
    assert rows(c, "pos", "n_ref", "n_alt", "low_qual") == [(4, 1, 3, False), (5, 2, 0, True)]
    t = X.tallies(c).first()
    assert (t["sites"], t["low_qual"], t["transitions"], t["transversions"]) == (2, 1, 1, 0)
    ids = spark.createDataFrame([("A",), ("Z",)], "id string")
    assert rows(X.missing_samples(g, ids)) == [("Z",)] and X.genotypes(spark, v, ids).select("sample").distinct().count() == 1


def test_codons(spark):
    g = spark.createDataFrame([("g", "CCCATGTTTGGGTAAAAA")], "name string, seq string")
    r = X.codon_statistics(g).first()
    assert (r["codons"], round(r["gc"], 6), round(r["gc3"], 6), r["cai"]) == (3, round(4 / 9, 6), round(2 / 3, 6), 1.0)
    assert X.codon_table(spark).filter("aa = '*'").count() == 3


def test_alignment_pieces(spark):
    p = spark.createDataFrame([("g", "hg", "chr1", 9, 12, "CC"), ("g", "hg", "chr1", 1, 4, "AA"), ("g", "pt", "chr1", 1, 4, "TT")], "gene string, species string, chrom string, start long, end long, seq string")
    assert rows(X.alignment_pieces(p, ["hg"]), "seq", "start", "end") == [("AA-CC", 1, 12)]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("chr10", 0, 0.0), ("chr2", 0, 0.0), ("chr2", 100, 0.5)], "chrom string, pos long, cum double")
    sinks.write_hapmap(p, str(tmp_path / "h"))
    assert ("chr2", 0, 5000.0) in rows(B.hapmap(spark, str(tmp_path / "h")), "chrom", "pos", "rate")
    sinks.write_marker_bed(p, str(tmp_path / "m"))
    assert B.bed3(spark, str(tmp_path / "m")).count() == 3
    b = spark.createDataFrame([("chr1", 1, 5, "x")], "chrom string, start long, end long, feature string")
    sinks.write_bed(b, str(tmp_path / "b"))
    sinks.write_bed(b, str(tmp_path / "b"), append=True)
    assert B.annotation(spark, str(tmp_path / "b")).count() == 2
    sinks.write_predictions(b, str(tmp_path / "p"), by_feature=True)
    sinks.write_window_table(b, str(tmp_path / "w"))
    t = spark.createDataFrame([("x", 1, 0.25), ("x", 0, 0.75)], "feature string, ti int, weight double")
    sinks.write_weights(t, str(tmp_path / "wt"))
    assert rows(sinks.weight_lines(t)) == [("x", "0.75,0.25")]
    sinks.write_bundle(str(tmp_path / "bundle"), windows=b, weights=t)
    assert sinks.read_bundle(spark, str(tmp_path / "bundle"), "windows")["windows"].count() == 1


def test_lifted(spark):
    m = spark.createDataFrame([("chr1", "chr1"), ("chr1", "chr2")], "chrom string, lifted_chrom string")
    assert B.lost_fraction(m, B.lifted(m)).first()["lost"] == 0.5


def test_stream(spark, tmp_path):
    from popspark.streaming import windows as S

    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1, 2, 2), ("a", 12, 1, 1)], S.SITES).write.parquet(src)
    q = S.window_sums(S.read_sites(spark, src), 10).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("sums").select("bin", F.col("n_diff"))) == [(0, 4.0), (1, 1.0)]


def test_genotypes_of_files_with_other_samples(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    put(tmp_path, "a.vcf", f"{head}A\tB\nchr1\t5\t.\tA\tG\t60\tPASS\t.\tGT:GQ\t0/1:40\t1|1:50\n")
    put(tmp_path, "b.vcf", f"{head}C\nchr2\t5\t.\tA\tG\t60\tPASS\t.\tGT:GQ\t0/0:40\n")
    got = X.genotypes(spark, f"{tmp_path}/*.vcf").select("chrom", "sample", "gt")
    assert sorted(map(tuple, got.collect())) == [("chr1", "A", "0/1"), ("chr1", "B", "1/1"), ("chr2", "C", "0/0")]
