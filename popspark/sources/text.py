"""Readers of sequence, model and genotype text, and what is counted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.functions.scalars import snp_class
from popspark.operators import scans


def fasta(spark: SparkSession, path, whole_header: bool = False) -> DataFrame:
    """(name, chunk_start, seq): one row for each line of sequence with its offset in the record.

    A file is read in byte ranges, however large it is.  Within a range windows number records and add up lengths; which
    record a range begins in, and how many of its bases came before, is scanned over one carry row for each range.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    head = F.col("value").startswith(">")
    name = F.expr("substring(value, 2)") if whole_header else F.regexp_extract("value", r"^>(\S+)", 1)
    size = F.when(head, 0).otherwise(F.length("value"))
    w = scans.until(scans.inside(["file"], "line"))
    t = t.withColumns({"own": F.sum(head.cast("int")).over(w), "name": F.last(F.when(head, name), ignorenulls=True).over(w), "size": size})
    record = W.partitionBy("file", "__block", "own").orderBy("line")
    t = t.withColumn("at", F.coalesce(F.sum("size").over(scans.earlier(record)), F.lit(0)))
    # of each range: records begun, the name of the last, and its bases so far
    per = t.groupBy("file", "__block").agg(F.max("own").alias("heads"), F.max_by("name", "line").alias("last"), F.max_by(F.col("at") + F.col("size"), "line").alias("tail"))
    order = W.partitionBy("file").orderBy("__block")
    per = per.withColumn("upto", F.sum("heads").over(scans.until(order)))
    per = per.withColumn("so_far", F.sum("tail").over(scans.until(W.partitionBy("file", "upto").orderBy("__block"))))
    per = per.select("file", "__block", F.coalesce(F.lag("so_far").over(order), F.lit(0)).alias("before"), F.last("last", ignorenulls=True).over(scans.earlier(order)).alias("open"))
    t = t.filter(~head & (F.col("value") != "")).join(per, ["file", "__block"])
    first = F.col("own") == 0
    return t.select(F.when(first, F.col("open")).otherwise(F.col("name")).alias("name"), (F.col("at") + F.when(first, F.col("before")).otherwise(0)).cast("long").alias("chunk_start"), F.col("value").alias("seq"))


def sequences(chunks: DataFrame) -> DataFrame:
    """(name, seq) with chunks joined, for records that fit a row, such as coding sequences."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_start", "seq")))
    return chunks.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


def cds_headers(rows: DataFrame) -> DataFrame:
    """gene, tx, chrom, start, end of names ``gene|tx|chrom|start|end``."""
    x = F.split("name", r"\|")
    return rows.withColumns({"gene": x[0], "tx": x[1], "chrom": x[2], "start": x[3].cast("long"), "end": x[4].cast("long")})


def alignment_regions(rows: DataFrame) -> DataFrame:
    """chrom, start, end, strand of the last ``chr:start-end`` in a name."""
    from popspark.functions.scalars import parse_region

    return rows.withColumn("region", parse_region(F.regexp_extract("name", r"(\S+:\d+-\d+[+-]?)", 1)))


def alignment_pieces(rows: DataFrame, species=None, chroms=None) -> DataFrame:
    """Pieces (gene, species, chrom, start, end, seq) joined with '-' in order, with the outer coordinates."""
    r = rows.filter(F.col("species").isin(*species)) if species else rows
    r = r.filter(F.col("chrom").isin(*chroms)) if chroms else r
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return r.groupBy("gene", "species", "chrom").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "-").alias("seq"), F.min("start").alias("start"), F.max("end").alias("end"))


MODEL_FILE = r"([^/]+?)\.([^/.]+)\.mod$"


def _models(spark: SparkSession, path, pattern: str) -> DataFrame:
    """(chrom, feature, value): whole texts of many small model files."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select(F.regexp_extract("path", pattern, 1).alias("chrom"), F.regexp_extract("path", pattern, 2).alias("feature"), "value")


def model_settings(spark: SparkSession, path, pattern: str = MODEL_FILE) -> DataFrame:
    """(chrom, feature, key, value) of the lines ``KEY: value``; the matrix and the tree have readers of their own."""
    t = _models(spark, path, pattern)
    line = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^([A-Z_]+:[^\n]*)$"), F.lit(1))).alias("x")
    t = t.select("chrom", "feature", line).select("chrom", "feature", F.regexp_extract("x", "^([A-Z_]+):", 1).alias("key"), F.trim(F.regexp_extract("x", "^[A-Z_]+:(.*)$", 1)).alias("value"))
    return t.filter(~F.col("key").isin("RATE_MAT", "TREE"))


def rate_matrix(spark: SparkSession, path, pattern: str = MODEL_FILE) -> DataFrame:
    """(chrom, feature, row, column, from, to, rate): the numbers below RATE_MAT, named by the alphabet's letters."""
    t = _models(spark, path, pattern)
    letters = F.split(F.trim(F.regexp_extract("value", r"ALPHABET:\s*([^\n]*)", 1)), r"\s+")
    body = F.regexp_extract("value", r"RATE_MAT:[^\n]*\n((?:[ \t]*[-+0-9.][^\n]*(?:\n|$))+)", 1)
    t = t.select("chrom", "feature", letters.alias("letters"), F.posexplode(F.split(F.trim(body), r"\n")).alias("row", "line"))
    t = t.filter("line <> ''").select("chrom", "feature", "letters", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("column", "rate"))
    return t.select("chrom", "feature", "row", "column", F.get("letters", F.col("row")).alias("from"), F.get("letters", F.col("column")).alias("to"), F.col("rate").cast("double").alias("rate"))


def parse_tree(tree) -> F.Column:
    """Array of (node, parent, name, length) of a tree in nested parentheses, inner nodes included; the root is node 0.

    A fold over the signs and labels with a stack of open nodes: a label after a closing sign belongs to the node that it closes.
    """
    node = "struct<node:int,parent:int,name:string,length:double>"
    zero = F.from_json(F.lit('{"stack":[],"closed":-1,"out":[]}'), f"stack array<int>, closed int, out array<{node}>")

    def made(parent, name, length, out):
        return F.struct(F.size(out).alias("node"), parent.alias("parent"), name.alias("name"), length.alias("length"))

    def step(acc, x):
        stack, closed, out = acc["stack"], acc["closed"], acc["out"]
        top = F.try_element_at(stack, F.lit(-1))
        none = F.lit(None)
        name, length = F.nullif(F.regexp_extract(x, "^([^:]*)", 1), F.lit("")), F.nullif(F.regexp_extract(x, ":(.*)$", 1), F.lit("")).cast("double")
        opened = F.struct(F.concat(stack, F.array(F.size(out))).alias("stack"), F.lit(-1).alias("closed"), F.concat(out, F.array(made(top, none.cast("string"), none.cast("double"), out))).alias("out"))
        shut = F.struct(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))).alias("stack"), F.coalesce(top, F.lit(-1)).alias("closed"), out.alias("out"))
        leaf = F.struct(stack.alias("stack"), F.lit(-1).alias("closed"), F.concat(out, F.array(made(top, name, length, out))).alias("out"))
        inner = F.transform(out, lambda n: F.when(n["node"] == closed, F.struct(n["node"].alias("node"), n["parent"].alias("parent"), name.alias("name"), length.alias("length"))).otherwise(n))
        labelled = F.when(closed >= 0, F.struct(stack.alias("stack"), F.lit(-1).alias("closed"), inner.alias("out"))).otherwise(leaf)
        between = F.struct(stack.alias("stack"), F.lit(-1).alias("closed"), out.alias("out"))
        return F.when(x == "(", opened).when(x == ")", shut).when(x.isin(",", ";"), between).otherwise(labelled)

    signs = F.regexp_extract_all(F.regexp_replace(tree, r"\s+", ""), F.lit(r"([(),;]|[^(),;]+)"), F.lit(1))
    return F.aggregate(signs, zero, step, lambda acc: acc["out"])


def model_trees(spark: SparkSession, path, pattern: str = MODEL_FILE) -> DataFrame:
    """(chrom, feature, node, parent, name, length) for every branch of the files' trees, inner ones with a null name."""
    t = _models(spark, path, pattern).select("chrom", "feature", F.regexp_extract("value", r"TREE:\s*([^\n]+)", 1).alias("tree"))
    return t.select("chrom", "feature", F.explode(parse_tree(F.col("tree"))).alias("n")).select("chrom", "feature", "n.*")


def branch_lengths(spark: SparkSession, path, pattern: str = MODEL_FILE) -> DataFrame:
    """(chrom, feature, species, length) of the named branches of many small model files."""
    return model_trees(spark, path, pattern).filter("name IS NOT NULL").select("chrom", "feature", F.col("name").alias("species"), "length")


def contigs(spark: SparkSession, path) -> DataFrame:
    """(chrom, length) from the header of a variant file."""
    t = spark.read.text(path).filter(F.col("value").startswith("##contig"))
    return t.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract("value", r"length=(\d+)", 1).cast("long").alias("length"))


def genotypes(spark: SparkSession, path, samples: DataFrame | None = None, zero_based: bool = True) -> DataFrame:
    """(chrom, pos, ref, alt, qual, filter, sample, gt, gq): one row for each site and sample; sample names are those of the row's own file, null where it names none."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    names = t.filter(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.split(F.first("value"), "\t").alias("h"))
    x = F.split("value", "\t")
    rows = t.filter(~F.col("value").startswith("#")).select("file", x.alias("x")).join(names, "file", "left")
    rows = rows.select(
        F.col("x")[0].alias("chrom"), (F.col("x")[1].cast("long") - (1 if zero_based else 0)).alias("pos"), F.col("x")[3].alias("ref"), F.col("x")[4].alias("alt"),
        F.expr("try_cast(x[5] as double)").alias("qual"), F.col("x")[6].alias("filter"), F.split(F.col("x")[8], ":").alias("format"),
        F.posexplode(F.slice("x", 10, F.size("x"))).alias("k", "call"), "h",
    )
    field = lambda name: F.try_element_at(F.split("call", ":"), F.nullif(F.array_position("format", name), F.lit(0)).cast("int"))
    rows = rows.withColumns({"sample": F.col("h")[F.col("k") + 9], "gt": F.translate(field("GT"), "|", "/"), "gq": F.coalesce(field("GQ"), field("RGQ")).try_cast("double")})
    if samples is not None:
        rows = rows.join(F.broadcast(samples.select(F.col("id").alias("sample"))), "sample", "left_semi")
    return rows.select("chrom", "pos", "ref", "alt", "qual", "filter", "sample", "gt", "gq")


def missing_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.join(rows.select(F.col("sample").alias("id")).distinct(), "id", "left_anti")


def allele_counts(rows: DataFrame, min_gq: float = 30, min_qual: float = 50, pass_only: bool = True) -> DataFrame:
    """Per site: reference and alternative alleles over samples of sufficient quality, and why others fell out.

    Homozygous reference calls count whatever the site's quality, alternative alleles only where it suffices.
    """
    snp = (F.length("ref") == 1) & F.col("alt").isin("A", "C", "G", "T", ".", "<NON_REF>")
    passed = F.col("filter").isin("PASS", ".") if pass_only else F.lit(True)
    good = F.coalesce(F.col("gq") >= min_gq, F.lit(False)) & F.col("gt").isNotNull() & ~F.col("gt").contains(".")
    q = F.coalesce(F.col("qual") >= min_qual, F.lit(False)).cast("int")
    n = lambda gt: F.count_if(good & F.col("gt").isin(*gt))
    g = rows.filter(passed).groupBy("chrom", "pos", "ref", "alt").agg(
        n(["0/0"]).alias("homref"), n(["0/1", "1/0"]).alias("het"), n(["1/1"]).alias("homalt"), F.max(q).alias("q"),
        F.count_if(~good).alias("low_gq"), F.max(snp.cast("int")).alias("snp"),
    )
    return g.select(
        "chrom", "pos", "ref", "alt", (2 * F.col("homref") + F.col("het") * F.col("q")).alias("n_ref"), ((2 * F.col("homalt") + F.col("het")) * F.col("q")).alias("n_alt"),
        "low_gq", (F.col("q") == 0).alias("low_qual"), (F.col("snp") == 0).alias("not_snp"),
    )


def tallies(counts: DataFrame) -> DataFrame:
    """Sites, rejects by reason, and transitions against transversions."""
    poly = (F.col("n_alt") > 0) & ~F.col("not_snp")
    kind = snp_class(F.col("ref"), F.col("alt"))
    ti, tv = F.count_if(poly & (kind == "transition")), F.count_if(poly & (kind == "transversion"))
    return counts.agg(F.count("*").alias("sites"), F.count_if("low_qual").alias("low_qual"), F.count_if("not_snp").alias("not_snp"), F.sum("low_gq").alias("low_gq"), ti.alias("transitions"), tv.alias("transversions"), (ti / F.nullif(tv, F.lit(0))).alias("ti_tv"))


_BASES = "TCAG"
#: Amino acids of the standard genetic code, codons in the order TCAG of each place; * stops.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table(spark: SparkSession) -> DataFrame:
    """(codon, aa, n_syn, n_non): changes of one base that keep or change the amino acid, each worth a third."""
    code = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
    rows = []
    for codon, aa in code.items():
        same = sum(code[codon[:p] + x + codon[p + 1 :]] == aa for p in range(3) for x in _BASES if x != codon[p])
        rows.append((codon, aa, same / 3, 3 - same / 3))
    return spark.createDataFrame(rows, "codon string, aa string, n_syn double, n_non double")


def codon_statistics(genes: DataFrame) -> DataFrame:
    """Per gene (name, seq): codons from the first start codon to before the first stop, GC, GC3, synonymous and
    non-synonymous sites, and the codon adaptation index against the usage over all genes."""
    table = F.broadcast(codon_table(genes.sparkSession))
    n = F.floor(F.length("seq") / 3).cast("int")
    codons = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.upper(F.substring("seq", k * 3 + 1, F.lit(3))))).otherwise(F.array())
    stops = F.array(*[F.lit(x) for x in ("TAA", "TAG", "TGA")])
    c = genes.select("name", codons.alias("c"))
    hits = F.filter(F.transform("c", lambda x, i: F.when(F.array_contains(stops, x), i)), lambda i: i.isNotNull())
    c = c.withColumn("c", F.slice("c", 1, F.coalesce(F.array_min(hits), F.size("c"))))
    first = F.array_position("c", "ATG").cast("int")
    c = c.filter(first > 0).select("name", F.slice("c", first, F.size("c")).alias("c"))
    rows = c.select("name", F.posexplode("c").alias("k", "codon")).join(table, "codon")
    use = rows.groupBy("aa", "codon").agg(F.count("*").alias("n"))
    weight = use.withColumn("w", F.col("n") / F.max("n").over(W.partitionBy("aa"))).select("codon", "w")
    gc = lambda x: F.length(x) - F.length(F.translate(x, "GC", ""))
    j = rows.join(F.broadcast(weight), "codon")
    return j.groupBy("name").agg(
        F.count("*").alias("codons"), (F.sum(gc(F.col("codon"))) / (3 * F.count("*"))).alias("gc"), F.avg(gc(F.substring("codon", 3, 1))).alias("gc3"),
        F.sum("n_syn").alias("syn_sites"), F.sum("n_non").alias("non_sites"), F.exp(F.avg(F.log("w"))).alias("cai"),
    )
