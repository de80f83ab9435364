"""Readers of tab-separated genomic tables.  Schemas are explicit; ``#`` lines are comments; gzip is transparent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tsv(spark: SparkSession, path, schema: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, **options)


def _known(rows: DataFrame, seqlens: DataFrame | None) -> DataFrame:
    return rows.join(F.broadcast(seqlens.select("chrom")), "chrom", "left_semi") if seqlens is not None else rows


def seqlens(spark: SparkSession, path, exclude=()) -> DataFrame:
    """(chrom, length)."""
    s = _tsv(spark, path, "chrom string, length long")
    return s.filter(~F.col("chrom").isin(*exclude)) if exclude else s


def bed3(spark: SparkSession, path, seqlens: DataFrame | None = None) -> DataFrame:
    """(chrom, start, end); further columns are ignored."""
    return _known(_tsv(spark, path, "chrom string, start long, end long", mode="PERMISSIVE"), seqlens)


def annotation(spark: SparkSession, path, seqlens: DataFrame | None = None) -> DataFrame:
    """(chrom, start, end, feature); without a fourth column the feature is ``undefined``; empty intervals are dropped."""
    a = _tsv(spark, path, "chrom string, start long, end long, feature string")
    return _known(a.withColumn("feature", F.coalesce("feature", F.lit("undefined"))).filter("end > start"), seqlens)


def unknown_chromosomes(rows: DataFrame, seqlens: DataFrame) -> DataFrame:
    return rows.select("chrom").distinct().join(F.broadcast(seqlens.select("chrom")), "chrom", "left_anti")


def coverage(spark: SparkSession, path) -> DataFrame:
    return _tsv(spark, path, "chrom string, start long, end long, n_overlaps int, bases long, width long, fraction double")


def hapmap(spark: SparkSession, path) -> DataFrame:
    """Markers (chrom, pos, rate in cM/Mb, cum in cM or null); a header line is skipped."""
    m = _tsv(spark, path, "chrom string, pos string, rate double, cum double")
    return m.withColumn("pos", F.expr("try_cast(pos as long)")).filter("pos IS NOT NULL")


def interval_map(spark: SparkSession, path, factor: float = 1e-8) -> DataFrame:
    """(chrom, start, end, rate in Morgans per base, cum) from an interval map."""
    m = _tsv(spark, path, "chrom string, start long, end long, rate double, cum double")
    return m.withColumn("rate", F.col("rate") * factor)


def covers_all(intervals: DataFrame, seqlens: DataFrame) -> DataFrame:
    """(chrom, complete): whether intervals follow each other without gaps from 0 to the end."""
    w = W.partitionBy("chrom").orderBy("start")
    gap = F.coalesce(F.lag("end").over(w), F.lit(0)) != F.col("start")
    g = intervals.withColumn("__gap", gap).groupBy("chrom").agg(F.max("__gap").alias("gap"), F.max("end").alias("last"))
    return g.join(F.broadcast(seqlens), "chrom").select("chrom", (~F.col("gap") & (F.col("last") == F.col("length"))).alias("complete"))


def intervals_to_markers(intervals: DataFrame) -> DataFrame:
    """Markers at interval starts."""
    return intervals.select("chrom", F.col("start").alias("pos"), "rate")


def cumulative_map(spark: SparkSession, path, seqlens: DataFrame) -> DataFrame:
    """Markers (chrom, pos, cum in cM) with one at 0 before and one at the chromosome's end after the given ones."""
    m = _tsv(spark, path, "chrom string, pos long, cum double")
    ends = m.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max_by("cum", "pos").alias("last")).join(F.broadcast(seqlens), "chrom")
    head = ends.filter("lo > 0").select("chrom", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("cum"))
    tail = ends.filter("hi < length").select("chrom", F.col("length").alias("pos"), F.col("last").alias("cum"))
    return m.unionByName(head).unionByName(tail)


def cumulative_bed(spark: SparkSession, path) -> DataFrame:
    """Markers (chrom, pos, cum) of intervals (chrom, start, end, cum) that reach the chromosome's end.

    An interval's value stands at its start; the last value stands at the end too.
    """
    m = _tsv(spark, path, "chrom string, start long, end long, cum double")
    last = m.groupBy("chrom").agg(F.max("end").alias("pos"), F.max_by("cum", "end").alias("cum"))
    return m.select("chrom", F.col("start").alias("pos"), "cum").unionByName(last)


def maps_by_file(spark: SparkSession, paths, pattern: str = r"(chr[^_./]+)") -> DataFrame:
    """Markers (chrom, pos, rate, cum) of files without a chromosome column; the name of the file has it."""
    m = spark.read.csv(paths, sep="\t", comment="#", schema="pos string, rate double, cum double")
    m = m.select(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias("chrom"), F.expr("try_cast(pos as long)").alias("pos"), "rate", "cum")
    return m.filter("pos IS NOT NULL")


def gff(spark: SparkSession, path, features=None, renames: dict | None = None) -> DataFrame:
    """GFF3 or GTF rows with 0-based half-open coordinates and attributes as a map; features selected and renamed.

    Of an attribute that a GTF row repeats the first value counts.
    """
    g = _tsv(spark, path, "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
    pair = F.lit(r'(\w+) "([^"]*)"')
    names, values = (F.regexp_extract_all("attributes", pair, F.lit(k)) for k in (1, 2))
    gtf = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda k: F.get(values, F.array_position(names, k) - 1)))
    gff3 = F.str_to_map(F.rtrim(F.col("attributes"), F.lit(";")), F.lit(";"), F.lit("="))
    g = g.withColumns({"start": F.col("start") - 1, "attributes": F.when(F.col("attributes").rlike(r'^\s*\w+ "'), gtf).otherwise(gff3)})
    if features:
        g = g.filter(F.col("feature").isin(*features))
    for old, new in (renames or {}).items():
        g = g.withColumn("feature", F.when(F.col("feature") == old, new).otherwise(F.col("feature")))
    return g


def gene_locations(rows: DataFrame) -> DataFrame:
    """Each gene's span and summed exon length through the exons' parents."""
    genes = rows.filter("feature = 'gene'").select(F.col("attributes")["ID"].alias("gene"), "chrom", "start", "end", "strand")
    tx = rows.filter(F.col("feature").isin("mRNA", "transcript")).select(F.col("attributes")["ID"].alias("tx"), F.col("attributes")["Parent"].alias("gene"))
    exons = rows.filter("feature = 'exon'").select(F.col("attributes")["Parent"].alias("tx"), (F.col("end") - F.col("start")).alias("size"))
    sums = exons.join(tx, "tx").groupBy("gene").agg(F.sum("size").alias("exon_bases"), F.countDistinct("tx").alias("transcripts"))
    return genes.join(sums, "gene", "left")


def conserved(spark: SparkSession, path) -> DataFrame:
    """Score track from conserved elements: score / 1000."""
    e = _tsv(spark, path, "chrom string, start long, end long, lod string, score double")
    return e.select("chrom", "start", "end", (F.col("score") / 1000).alias("score"))


def score_bed(spark: SparkSession, path, mode: str = "max") -> DataFrame:
    """Score track from (chrom, start, end, count, mean, max)."""
    e = _tsv(spark, path, "chrom string, start long, end long, count long, mean double, max double")
    return e.select("chrom", "start", "end", F.col(mode).alias("score"))


def bedgraph(spark: SparkSession, path) -> DataFrame:
    """Score track from bedGraph text; NaN is missing."""
    t = _tsv(spark, path, "chrom string, start long, end long, score double")
    return t.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def counts(spark: SparkSession, path) -> DataFrame:
    """Sites (chrom, pos, n_ref, n_alt) from (chrom, pos, n_total, n_derived)."""
    c = _tsv(spark, path, "chrom string, pos long, n_total int, n_derived int")
    return c.select("chrom", "pos", (F.col("n_total") - F.col("n_derived")).alias("n_ref"), F.col("n_derived").alias("n_alt"))


def metadata(spark: SparkSession, path) -> DataFrame:
    """(path, params) from ``#k=v;k=v`` lines."""
    from popspark.functions.scalars import parse_params

    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.filter(F.col("value").startswith("#") & F.col("value").contains("=")).select("path", parse_params(F.col("value")).alias("params"))


def counts_dir(spark: SparkSession, path) -> DataFrame:
    """Sites from Parquet partitioned by chromosome; a filter on chrom reads only its folders."""
    return spark.read.parquet(path)


def centromeres(spark: SparkSession, path) -> DataFrame:
    """(chrom, edges): sorted distinct ends of the ``acen`` bands."""
    b = _tsv(spark, path, "chrom string, start long, end long, arm string, band string").filter("band = 'acen'")
    return b.select("chrom", F.explode(F.array("start", "end")).alias("edge")).groupBy("chrom").agg(F.sort_array(F.collect_set("edge")).alias("edges"))


def external_maps(spark: SparkSession, path, pattern: str = r"mu([^_/]+)_s([^/]+)/(chr[^./]+)") -> DataFrame:
    """(chrom, mu, s, pos, b) from files of (B x 1000, run width); names of folder and file carry mu, s and chrom."""
    p = F.col("_metadata.file_path")
    r = spark.read.text(path).select(p.alias("path"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("x"))
    r = r.filter(~F.col("x")[0].startswith("#"))
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    part = lambda k: F.regexp_extract("path", pattern, k)
    return r.select(part(3).alias("chrom"), part(1).cast("double").alias("mu"), part(2).cast("double").alias("s"), F.sum(F.col("x")[1].cast("long")).over(w).alias("pos"), (F.col("x")[0].cast("double") / 1000).alias("b"))


def path_params(rows: DataFrame, path: str = "path") -> DataFrame:
    """``params`` map from ``key__value`` folders and ``rep1_seed2`` names in a path."""
    pairs = F.regexp_extract_all(path, F.lit(r"([A-Za-z]\w*?)__([^/]+)"), F.lit(0))
    named = F.transform(pairs, lambda x: F.struct(F.split(x, "__")[0].alias("k"), F.split(x, "__")[1].alias("v")))
    rep = F.regexp_extract_all(path, F.lit(r"(rep|seed)(\d+)"), F.lit(0))
    more = F.transform(rep, lambda x: F.struct(F.regexp_extract(x, r"^[a-z]+", 0).alias("k"), F.regexp_extract(x, r"\d+", 0).alias("v")))
    return rows.withColumn("params", F.map_from_entries(F.concat(named, more)))


def files(spark: SparkSession, path, suffix: str) -> DataFrame:
    """Paths of all files under a folder that end in ``suffix``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return f.select("path", "length")


def substitutions(spark: SparkSession, path) -> DataFrame:
    """Rows (chrom, pos, sel, mtype, h) of many files, each with the parameters of its header line."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    x = F.split("value", "\t")
    rows = t.select("path", x[0].alias("chrom"), x[1].cast("long").alias("pos"), x[2].cast("double").alias("sel"), x[3].alias("mtype"), x[4].cast("double").alias("h"))
    return rows.join(F.broadcast(metadata(spark, path)), "path", "left")


def event_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events by parameters, selection and position."""
    return rows.groupBy(*[F.col("params")[k].alias(k) for k in keys], "sel", "pos").agg(F.count("*").alias("n"))


def fits_tree(spark: SparkSession, path) -> DataFrame:
    """Result tables of many fits from a tree of ``key=value`` folders; the keys become columns."""
    return spark.read.option("basePath", path).parquet(path)


def id_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def populations(spark: SparkSession, path, population: str) -> DataFrame:
    """Samples of one population from (sample, population)."""
    return _tsv(spark, path, "id string, population string").filter(F.col("population") == population).select("id")


def lifted(rows: DataFrame) -> DataFrame:
    """Markers whose lifted chromosome (column lifted_chrom) is still their own."""
    return rows.filter(F.col("chrom") == F.col("lifted_chrom"))


def lost_fraction(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("n")), after.agg(F.count("*").alias("m"))
    return a.crossJoin(b).select("n", "m", (1 - F.col("m") / F.col("n")).alias("lost"))
