"""Token counts of documents in flat token files that have no index, by a separator scan.

A token file is a run of 16-bit ids in which an end-of-document id closes each document.  It is read as blocks
that end anywhere, also inside a document.  Each block searches its ids for the separator with NumPy and returns
one row for each piece of a document it holds.  A prefix scan over the blocks' separator counts, one small row for
each block, tells every block how many documents end before it; pieces of one document then share a number and
their lengths add up.

``write_token_files`` tokenises documents into such files: rows (file, block, ids) of a table, each ``ids`` a raw
little-endian array of at most ``BLOCK`` bytes, plus the order of the documents in each file.  ``read_flat`` makes
the same rows from real flat files.

Defined results: a null text counts as empty and has 0 tokens; ids after the last separator are a document that is
not closed (its ``closed`` is false); an empty file has no documents; an empty table gives an empty table;
repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.llm.common import byte_slices, documents, scratch_path, stored

TOKENIZER = "byte_bpe_50k.tiktoken"
SEPARATOR = 50256
#: Bytes of a block.
BLOCK = 1 << 18
WIDTH = np.dtype("<u2")

_ENCODERS: dict = {}


def _encoder(name: str):
    """The public vocabulary without special tokens: their strings in a text are ordinary text."""
    if name not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
        _ENCODERS[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def write_token_files(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """Rows (file, block, ids, docs): raw blocks, and on each row the doc_ids whose text begins while it is filled.

    A file is what one task writes; its blocks and the order of its documents are settled once the table is
    written.
    """

    def run(batches):
        encoder, file, block = _encoder(name), TaskContext.get().partitionId(), 0
        held, ids = bytearray(), []

        def row(data):
            return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "ids": [bytes(data)], "docs": [ids]}, schema=_FILES)

        for b in byte_slices(batches, "text", 1_000_000):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                tokens = encoder.encode_ordinary(text or "")
                tokens.append(SEPARATOR)
                held += np.array(tokens, WIDTH).tobytes()
                ids.append(doc)
                while len(held) >= BLOCK:
                    yield row(held[:BLOCK])
                    del held[:BLOCK]
                    block, ids = block + 1, []
        if held or ids:
            yield row(held)

    path = scratch_path(docs.sparkSession, "tokens")
    files = docs.select("doc_id", "text").mapInArrow(run, "file long, block long, ids binary, docs array<bigint>")
    files.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(files.schema).parquet(path)


_FILES = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("docs", pa.list_(pa.int64()))])


def read_flat(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (file, block, ids) from flat binary files; the last block of a file may be short.

    Each file is one row of the reader, so files should be of the size that writers of token shards use.
    """
    whole = spark.read.format("binaryFile").load(path)
    starts = F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(block))).alias("block", "start")
    return whole.select(F.col("path").alias("file"), "content", starts).select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("start") + 1, F.lit(block)).alias("ids"))


def pieces(blocks: DataFrame, separator: int = SEPARATOR, width=WIDTH) -> DataFrame:
    """(file, block, piece, tokens, closed, ends) for each piece of a document in a block; ``ends``: separators in the block."""
    width = np.dtype(width)

    def run(batches):
        for b in batches:
            out: dict = {"file": [], "block": [], "piece": [], "tokens": [], "closed": [], "ends": []}
            for file, block, raw in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(raw, width)
                at = np.flatnonzero(ids == separator)
                tail = len(ids) - (at[-1] + 1 if len(at) else 0)
                tokens = np.append(np.diff(at, prepend=-1) - 1, tail)
                n = len(tokens) if tail or not len(at) else len(at)
                out["file"] += [file] * n
                out["block"] += [block] * n
                out["piece"] += range(n)
                out["tokens"] += tokens[:n].tolist()
                out["closed"] += [True] * len(at) + [False] * (n - len(at))
                out["ends"] += [len(at)] * n
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", b.schema.field("file").type), ("block", pa.int64()), ("piece", pa.int64()), ("tokens", pa.int64()), ("closed", pa.bool_()), ("ends", pa.int64())]))

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "ids").mapInArrow(run, f"file {kind}, block long, piece long, tokens long, closed boolean, ends long")


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, width=WIDTH) -> DataFrame:
    """(file, doc_no, n_tokens, closed) for each document of each file of ``blocks`` (file, block, ids)."""
    found = stored(pieces(blocks, separator, width), "pieces")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = found.filter("piece = 0").select("file", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"))
    placed = found.join(stored(scan, "scan").hint("merge"), ["file", "block"])
    return placed.groupBy("file", (F.col("before") + F.col("piece")).alias("doc_no")).agg(F.sum("tokens").alias("n_tokens"), F.max("closed").alias("closed"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(documents(spark, sf_dir))
    counts = token_counts(files)
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    begun = files.select("file", "block", "docs").withColumn("before", F.coalesce(F.sum(F.size("docs")).over(earlier), F.lit(0)))
    order = begun.select("file", "before", F.posexplode("docs").alias("nth", "doc_id")).select("file", (F.col("before") + F.col("nth")).alias("doc_no"), "doc_id")
    return order.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")
