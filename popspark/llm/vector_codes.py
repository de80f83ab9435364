"""Vector codes: product quantisation whose nearest entries are found by an equal-average search.

A vector of integers is cut into ``PARTS`` consecutive parts, and each part is coded as the index of its nearest
codebook entry.  By Cauchy and Schwarz the squared gap between two component sums, over the dimension, is at most
the squared distance.  So entries are sorted by sum, and the search goes outwards from a part's own sum, one entry
below and one above at a time, until on a side the squared gap over the dimension strictly exceeds the best distance.

The vectors are written once, packed.  A round reads them, each task sends one row of sums and counts for each
entry that it used (at most ``PARTS`` x ``ENTRIES`` rows of one part's length), and Spark adds these up; only the codebooks, whose size does not depend
on the number of vectors, are on the driver and in the tasks' closures.

Defined results: vectors that are null or hold null or non-finite components are dropped.  Codebooks are for the
most frequent length among the others (of equally frequent ones the greatest); vectors of another length have null code and error.  A length that
``PARTS`` does not divide is cut where k * length // PARTS falls.  Null vec_ids come after all others, and rows with one vec_id are in order of
their vectors.  With fewer vectors than ``ENTRIES`` there are as many entries.  Integers are held within +-``limit``, beyond which errors would leave a
long; ``label_error`` is null where the sum does.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared at once.
CHUNK = 4096


def limit(length: int) -> int:
    """Components of this size at most keep the squared distance of two vectors within 2**62."""
    return math.isqrt(2**60 // max(1, length))


def cuts(length: int) -> list[int]:
    return [k * length // PARTS for k in range(PARTS + 1)]


class EqualAverage:
    """Nearest entry of one codebook part, of equally near ones that with the lowest index."""

    def __init__(self, entries: np.ndarray):
        order = np.argsort(entries.sum(axis=1), kind="stable")
        self.entries, self.index = entries[order], order
        self.sums, self.dim = self.entries.sum(axis=1), max(1, entries.shape[1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``x``."""
        own = x.sum(axis=1)
        start = np.searchsorted(self.sums, own)
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.index))
        live = {-1: np.arange(len(x)), 1: np.arange(len(x))}
        for step in range(len(self.index)):
            for side in live:
                rows = live[side]
                e = start[rows] - 1 - step if side < 0 else start[rows] + step
                inside = (e >= 0) & (e < len(self.index))
                rows, e = rows[inside], e[inside]
                gap = self.sums[e] - own[rows]
                near = -(-gap * gap // self.dim) <= best[rows]  # the division rounded up: exact for whole distances
                rows, e = rows[near], e[near]
                live[side] = rows
                if not len(rows):
                    continue
                d = x[rows] - self.entries[e]
                d, i = np.einsum("ij,ij->i", d, d), self.index[e]
                closer = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
                best[rows[closer]], at[rows[closer]] = d[closer], i[closer]
            if not (len(live[-1]) or len(live[1])):
                break
        return at, best


def _kind(rows: DataFrame) -> str:
    return rows.schema["label"].dataType.simpleString()


def packed(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, length, packed): valid vectors as little-endian 32-bit integers floor(scale * x)."""

    def run(batches):
        for b in batches:
            lists = b.column("v")
            lengths = np.diff(np.asarray(lists.offsets))
            q = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            most = np.repeat([min(limit(n), 2**31 - 1) for n in lengths.tolist()], lengths).astype(np.float64)
            q = np.clip(q, -most, most).astype("<i4")
            ends = np.cumsum(lengths)
            rows = [q[e - n : e].tobytes() for n, e in zip(lengths, ends)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(lengths, pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "label", "length", "packed"])

    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    return valid.mapInArrow(run, f"vec_id long, label {_kind(vectors)}, length int, packed binary")


def _first(rows: DataFrame, length: int, entries: int) -> np.ndarray:
    """The vectors with the smallest vec_ids: a top-k of a bounded number of rows."""
    first = rows.filter(F.col("length") == length).orderBy(F.col("vec_id").asc_nulls_last(), F.hex("packed")).limit(entries).select("packed").collect()
    return np.array([np.frombuffer(r["packed"], "<i4") for r in first], np.int64).reshape(len(first), length)


def _batches(batches, length: int):
    """(batch, vectors) of the rows of this length, some thousand rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            rows = [r for r, n in zip(part.column("packed").to_pylist(), part.column("length").to_pylist()) if n == length]
            yield part, np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), length).astype(np.int64)


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _sums(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): the number and the sums of the parts nearest to each entry."""
    at = cuts(length)
    width = max(b - a for a, b in zip(at, at[1:]))

    def run(batches):
        searches = [EqualAverage(b) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for _, x in _batches(batches, length):
            for k, search in enumerate(searches):
                part = x[:, at[k] : at[k + 1]]
                near, _ = search.nearest(part)
                np.add.at(total[k], near, part)
                count[k] += np.bincount(near, minlength=len(count[k]))
        for k in range(PARTS):
            used = np.flatnonzero(count[k])
            if len(used):
                yield pa.RecordBatch.from_pydict({"part": [k] * len(used), "entry": used, "n": count[k][used], "sums": total[k][used].tolist()}, schema=_SUMS)

    found = rows.mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])


def codebooks(rows: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of the parts after ``rounds`` rounds over all ``rows`` of this length."""
    first, at = _first(rows, length, entries), cuts(length)
    books = [first[:, a:b].copy() for a, b in zip(at, at[1:])]
    for _ in range(rounds):
        for r in _sums(rows, books, length).collect():  # a row for each entry, whatever the number of vectors
            size = at[r["part"] + 1] - at[r["part"]]
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """(vec_id, label, code, error) of packed rows."""
    at = cuts(length)

    def run(batches):
        searches = [EqualAverage(b) for b in books]
        for b, x in _batches(batches, length):
            error, near = np.zeros(len(x), np.int64), np.zeros((len(x), PARTS), np.uint8)
            for k, search in enumerate(searches):
                near[:, k], d = search.nearest(x[:, at[k] : at[k + 1]])
                error += d
            fits = np.asarray(b.column("length")) == length
            code, cost = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            code[fits], cost[fits] = [r.tobytes().hex() for r in near], error
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(cost, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {_kind(rows)}, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approx``: the vector that the code stands for."""

    def run(batches):
        for b in batches:
            out = [None if c is None else np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(c))]) / scale for c in b.column("code").to_pylist()]
            yield b.append_column("approx", pa.array(out, pa.list_(pa.float64())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{kinds}, approx array<double>")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the valid ``vectors`` (vec_id, embedding, label), and the codebooks."""
    rows = stored(packed(vectors), "packed")
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    length = lengths["length"] if lengths else 0
    books = codebooks(rows, length)
    return encode(rows, books, length), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = stored(codes, "codes")
    totals = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))  # Spark sends it to all tasks where it is small
    by_label = codes.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label")))
    return by_label.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Rounds are written out one by one; a part's entries are compared with all entries, without the search.
SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, vec_id, p, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) AS v FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
"""
for _k in range(ROUNDS + 1):
    SQL += f"""
a{_k} AS MATERIALIZED (
  SELECT r, p, v, near.e AS e, near.d AS d FROM (
    SELECT x.r, x.p, any_value(x.v) AS v, min({{'d': list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT, 'e': b.e}}) AS near
    FROM x JOIN b{_k} b ON x.p = b.p GROUP BY x.r, x.p)),"""
    if _k < ROUNDS:
        SQL += f"""
m{_k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
  SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM a{_k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{_k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{_k} b LEFT JOIN m{_k} m USING (p, e)),"""
SQL += f"""
s AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(v, ',') AS c FROM b{ROUNDS})),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN c USING (r), s
"""
