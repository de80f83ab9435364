"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction; a vector belongs to it when their inner product exceeds a height.  Directions are tuples
of random codewords, one for each block of coordinates, so a code of k words a block has k ** BLOCKS filters, and
the ones that a vector exceeds are list-decoded from its k inner products in each block without looking at the
rest.  Close vectors share a filter with high probability, far ones seldom; k follows the number of vectors, so
the members of a filter, and with them the work for a vector, stay about constant.  Vectors that share label and
filter are compared in double precision.

Equal vectors are a class with a count.  A filter with many members is cut into blocks, and each pair of blocks is
a task of its own, so no task holds more than 2 * BLOCK vectors.  A task returns link counts and a spanning set of
links, never its pairs; a pair is counted only in the least filter that both vectors have.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have a null label link with
nothing; vectors of different lengths do not link; equal vectors link (cosine 1); repeated vec_ids each get a row;
an empty table gives an empty result; further columns are ignored.  Recall is measured in tests/llm.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import stored
from popspark.llm.components import components

COSINE = 0.98
BLOCKS = 3
#: Filters that a vector exceeds, on average and at least.
FILTERS = 10
LEAST = 4
#: Vectors in a block of a large filter.
BLOCK = 1000


class Code:
    """Random product code over vectors of one length."""

    def __init__(self, length: int, words: int, seed: int = 5):
        self.cuts = np.array_split(np.arange(length), min(BLOCKS, length))
        rng = np.random.default_rng([seed, length, words])
        self.words, self.books = words, []
        for cut in self.cuts:
            book = rng.standard_normal((words, len(cut)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(len(self.cuts)))
        self.height = self._height(rng, length)

    def _height(self, rng, length: int) -> float:
        """Inner product that a random direction exceeds for FILTERS filters on average."""
        total = self.words ** len(self.cuts)
        if total <= FILTERS:
            return -1.0
        guess = NormalDist().inv_cdf(1 - min(0.5, FILTERS / total)) / np.sqrt(length)
        x = rng.standard_normal((64, length))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for _ in range(12):
            mean = np.mean([len(f) for f in self._decode(x, guess)])
            if mean >= FILTERS:
                break
            guess -= 0.004
        return guess

    def _decode(self, x: np.ndarray, height: float) -> list[np.ndarray]:
        """For each unit vector the numbers of the filters over ``height``, block after block with pruning."""
        products = [x[:, cut] @ book.T for cut, book in zip(self.cuts, self.books)]
        best = np.append(np.cumsum([p.max(axis=1) for p in products[::-1]], axis=0)[::-1][1:], np.zeros((1, len(x))), axis=0)
        row, number, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for p, rest in zip(products, best):
            ahead = total[:, None] + p[row]
            at, word = np.nonzero(ahead >= height - rest[row][:, None])
            row, number, total = row[at], number[at] * self.words + word, ahead[at, word]
        order = np.lexsort((number, row))
        return np.split(number[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of unit vectors; those with few get the height lowered until they have LEAST."""
        out: list = [None] * len(x)
        step = max(1, 4_000_000 // self.words**2)
        for at in range(0, len(x), step):
            todo, height = np.arange(at, min(at + step, len(x))), self.height
            while len(todo):
                got = self._decode(x[todo], height)
                short = []
                for i, f in zip(todo.tolist(), got):
                    if len(f) >= min(LEAST, self.words ** len(self.cuts)):
                        out[i] = f
                    else:
                        short.append(i)
                todo, height = np.array(short, np.int64), height - 0.02
        return out


def _coded(classes: DataFrame, words: int) -> DataFrame:
    def run(batches):
        codes: dict[int, Code] = {}
        for b in batches:
            column = b.column("embedding")
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            values, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(size))
            out: list = [None] * len(size)
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                code = codes.setdefault(length, Code(length, words))
                x = values[at[rows][:, None] + np.arange(length)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                for i, f in zip(rows.tolist(), code.filters(x / np.linalg.norm(x, axis=1, keepdims=True))):
                    out[i] = f
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "filters"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{schema}, filters array<bigint>")


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare(cosine: float):
    """Links within a pack of tasks: (vector, null, linked vectors) and a spanning set (vector, vector, 0)."""

    def unit(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def earlier(f, lists, size):
        """Which pairs of rows share a filter less than ``f``; ``lists``: all rows' filters, ``size``: how many each."""
        row = np.repeat(np.arange(len(size)), size)[lists < f]
        names, at = np.unique(lists[lists < f], return_inverse=True)
        held = np.zeros((len(size), len(names)), np.float32)
        held[row, at] = 1
        return held @ held.T > 0

    def flat(column):
        x = column.combine_chunks()
        return x.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("label", "dim", "filter", "i", "j", "block", "vec_id")])
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "filter", "i", "j")])
        new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        ids, copies, block = (table.column(c).to_numpy() for c in ("vec_id", "copies", "block"))
        (vectors, at), (filters, fat) = flat(table.column("embedding")), flat(table.column("filters"))
        out_a, out_b, out_n = [], [], []
        for a, z in zip(new.tolist(), np.append(new[1:], table.num_rows).tolist()):
            if z - a < 2:
                continue
            x = unit(vectors[at[a] : at[z]].reshape(z - a, -1).astype(np.float64))
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if keys[3, a] != keys[4, a]:  # two blocks: only pairs across
                near &= block[a:z, None] != block[None, a:z]
            i, j = np.nonzero(np.triu(near))
            if not len(i):
                continue
            own = ~earlier(keys[2, a], filters[fat[a] : fat[z]], np.diff(fat[a : z + 1]))[i, j]
            got = np.bincount(i[own], weights=copies[a:z][j[own]], minlength=z - a) + np.bincount(j[own], weights=copies[a:z][i[own]], minlength=z - a)
            label = np.arange(z - a)
            while True:
                low = label.copy()
                np.minimum.at(low, i, label[j])
                np.minimum.at(low, j, label[i])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            some, moved = np.flatnonzero(got), np.flatnonzero(label != np.arange(z - a))
            out_a += [ids[a:z][some], ids[a:z][moved]]
            out_b += [np.full(len(some), -1), ids[a:z][label[moved]]]
            out_n += [got[some].astype(np.int64), np.zeros(len(moved), np.int64)]
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        a, b, n = cat(out_a), cat(out_b), cat(out_n)
        return pa.Table.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], schema=_FOUND)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col("embedding")
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, sound) & F.exists(v, lambda x: x != 0)
    keyed = vectors.select("vec_id", "label", v, F.coalesce(valid, F.lit(False)).alias("valid"), F.xxhash64("embedding").alias("k1"), F.xxhash64("embedding", F.lit(7)).alias("k2"))
    key = ["label", "dim", "k1", "k2"]
    keyed = keyed.withColumn("dim", F.size("embedding"))
    members = stored(keyed.filter("valid").select("vec_id", *key), "vectors")
    classes = keyed.filter("valid").groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").cast("long").alias("copies"), F.first("embedding").alias("embedding"))
    classes = stored(classes, "classes")
    count = classes.count()
    words = max(4, int(np.ceil(count ** (1 / BLOCKS))))
    coded = stored(_coded(classes.select("vec_id", "label", "dim", "copies", "embedding"), words), "coded")

    narrow = coded.select("vec_id", "label", "dim", F.explode("filters").alias("filter"))
    shared = stored(narrow.groupBy("label", "dim", "filter").agg(F.count("*").alias("m")).filter("m > 1").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "shared")
    load = shared.agg(F.sum(F.col("m") * F.col("parts"))).first()[0] or 0
    packs = max(1, -(-load // 4000))
    wanted = narrow.join(shared.hint("merge"), ["label", "dim", "filter"]).groupBy("vec_id").agg(F.collect_list(F.struct("filter", "parts")).alias("wanted"))
    rows = coded.join(wanted.hint("merge"), "vec_id").select("*", F.explode("wanted").alias("w")).select("vec_id", "label", "dim", "copies", "embedding", "filters", "w.filter", "w.parts")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.withColumn("pack", F.pmod(F.xxhash64("label", "dim", "filter", "i", "j"), F.lit(packs))).drop("parts", "other")
    found = stored(rows.groupBy("pack").applyInArrow(_compare(cosine), "a long, b long, n long"), "found")

    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    labels = stored(components(found.filter("b IS NOT NULL").select("a", "b")), "labels")
    told = classes.select(*key, "copies", F.col("vec_id").alias("id")).join(counts.hint("merge"), "id", "left").join(labels.hint("merge"), "id", "left")
    told = stored(told.select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "told")
    good = members.join(told.hint("merge"), key).select("vec_id", "n_links", "component_id")
    rest = keyed.filter("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: Every pair of a label by definition; on the given tables the filters miss none.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN found ON found.a = vec_id
"""
