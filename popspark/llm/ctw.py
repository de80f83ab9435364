"""Language-model scoring by context-tree weighting over bytes, beside a unigram base.

A text is its lower-cased words joined by spaces and closed by a line feed.  Each byte is eight binary decisions,
and each decision node has a tree of contexts: the preceding bytes, up to ``DEPTH``.  A context predicts with the
Krichevsky-Trofimov estimate of the counts it saw in training; context-tree weighting mixes the estimates of all
depths by how well each did there.  Trained weights stay fixed: the probability of a decision is
``beta * KT + (1 - beta) * (that of the next deeper context)``, from the deepest context that training visited.

How it runs: tasks reduce training text to distinct (context, byte) strings and counts; buckets by the two nearest
context bytes merge them (salted by task first, so a bucket's load stays bounded) and own whole subtrees of depth
two and more.  The tables of depths 0 and 1, at most 256 * 255 nodes, are the only ones gathered and shipped.  To
score, units of documents ask the buckets for their distinct strings and words and add the answers up; neither the
strings nor the word counts are ever held in one place.

Defined results: null text counts as empty, a text of only its end token; null doc_ids have no fold and are not
trained on; ties and repeated rows do not matter, each row gets a row; without training text every decision has
chance 1/2; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import Words, byte_slices, documents, folded, mix, stored, text_bytes
from popspark.llm.exchange import BACK, _BACK, _SENT, SENT, _deal, add_up, buckets_for, unit_column, units_for

DEPTH = 5
END = 10
_U = np.uint64


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


class Stream:
    """The byte streams of texts with their contexts: for each coded byte, the string (context, byte) as one number."""

    def __init__(self, words: Words, depth: int = DEPTH):
        w, n = words, len(words.count)
        # every word is followed by a space, the last of a text by the end instead; texts without words are an end
        size = np.diff(np.append(0, np.cumsum(w.end - w.start + 1))) if len(w.start) else np.zeros(0, np.int64)
        body = np.bincount(w.doc, weights=size, minlength=n).astype(np.int64)
        self.size = np.where(w.count > 0, body, 1)
        at = np.append(0, np.cumsum(self.size + depth))
        data = np.full(at[-1], END, np.uint8)
        if len(size):
            begin = np.cumsum(size) - size
            begin = begin - begin[w.first[:-1][w.doc]] + at[w.doc] + depth
            inside = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
            data[np.repeat(begin, size - 1) + inside] = w.data[np.repeat(w.start, size - 1) + inside]
            follows = np.append(w.doc[1:] == w.doc[:-1], False)
            data[(begin + size - 1)[follows]] = 32
        grams = np.zeros(len(data), np.uint64)
        for k in range(depth + 1):
            grams[depth:] = (grams[depth:] << _U(8)) | data[k : len(data) - depth + k]
        coded = np.ones(len(data), bool)
        for k in range(depth):
            coded[at[:-1] + k] = False
        self.grams = grams[coded]
        self.first = np.append(0, np.cumsum(self.size))


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, weight = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], weight[order]
    new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    return flat[new], np.add.reduceat(weight, new) if len(new) else weight


def _near(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a string by its two nearest context bytes."""
    return (mix((grams >> _U(8)) & _U(0xFFFF)) % _U(buckets)).astype(np.int64)


_GRAMS = "bucket long, salt long, grams binary, counts binary"


def gram_counts(docs: DataFrame, buckets: int, salts: int) -> DataFrame:
    """One row for each bucket: its distinct strings in training text, sorted, and their counts."""
    schema = pa.schema([("bucket", pa.int64()), ("salt", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])

    def rows(grams, counts, salt):
        bucket = _near(grams, buckets)
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        at = np.append(at, len(order))
        grams, counts = grams[order], counts[order]
        parts = [slice(a, b) for a, b in zip(at[:-1], at[1:])]
        return {"bucket": names, "salt": [salt] * len(names), "grams": [grams[p].tobytes() for p in parts], "counts": [counts[p].tobytes() for p in parts]}

    def count(batches):
        held, weight = [], []
        for b in byte_slices(batches, "text", 4_000_000):
            g, c = np.unique(Stream(Words(b.column("text"), lower=True)).grams, return_counts=True)
            held.append(g)
            weight.append(c.astype(np.int64))
            if sum(map(len, held)) > 3_000_000:
                g, c = _summed(held, weight)
                held, weight = [g], [c]
                if len(g) > 1_500_000:
                    yield pa.RecordBatch.from_pydict(rows(g, c, TaskContext.get().partitionId() % salts), schema=schema)
                    held, weight = [], []
        if held:
            yield pa.RecordBatch.from_pydict(rows(*_summed(held, weight), TaskContext.get().partitionId() % salts), schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        g, c = _summed([np.frombuffer(x, _U) for x in table.column("grams").to_pylist()], [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        return pa.Table.from_pydict({"bucket": [table.column("bucket")[0].as_py()], "salt": [0], "grams": [g.tobytes()], "counts": [c.tobytes()]}, schema=schema)

    found = docs.select("text").mapInArrow(count, _GRAMS)
    if salts > 1:
        found = found.groupBy("bucket", "salt").applyInArrow(merge, _GRAMS)
    return found.groupBy("bucket").applyInArrow(merge, _GRAMS)


class Tree:
    """Nodes of depths ``DEPTH`` down to 2 of the strings of a bucket.  A node is (context, decision): ``context << 8 | decision``."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        byte = grams & _U(255)
        keys, zeros, ones = [], [], []
        for bit in range(8):
            decision = (_U(1) << _U(bit)) | (byte >> _U(8 - bit))
            one = ((byte >> _U(7 - bit)) & _U(1)).astype(bool)
            keys.append(((grams >> _U(8)) << _U(8)) | decision)
            zeros.append(np.where(one, 0, counts))
            ones.append(np.where(one, counts, 0))
        key, zero, one = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
        below = np.zeros(len(key))
        self.levels = {}
        for d in range(depth, 0, -1):
            order = np.argsort(key, kind="stable")
            key, zero, one, below = key[order], zero[order], one[order], below[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, new) if len(new) else x
            key, zero, one, below = key[new], add(zero), add(one), add(below)
            if d == 1:
                self.near = key, zero, one, below
                break
            kt, half = log_kt(zero, one), np.log(0.5)
            weighted = kt if d == depth else np.logaddexp(half + kt, half + below)
            beta = np.ones(len(key)) if d == depth else np.exp(half + kt - weighted)
            self.levels[d] = key, (one + 0.5) / (zero + one + 1.0), beta
            below = weighted
            key = key & _U((1 << (8 * d)) - 1)  # drop the farthest context byte

    def chances(self, grams: np.ndarray, top: tuple) -> np.ndarray:
        """log10 probability of the byte of each string after its context."""
        byte, out = grams & _U(255), np.zeros(len(grams))
        for bit in range(8):
            decision = (_U(1) << _U(bit)) | (byte >> _U(8 - bit))
            p = np.full(len(grams), np.nan)
            for d, (key, kt, beta) in [*self.levels.items(), *((d, t) for d, t in zip((1, 0), top))]:
                want = (((grams >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | decision
                at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
                seen = key[at] == want if len(key) else np.zeros(len(want), bool)
                if not seen.any():
                    continue
                own, b = kt[at], beta[at]
                p = np.where(seen, np.where(np.isnan(p), own, b * own + (1 - b) * p), p)
            p = np.where(np.isnan(p), 0.5, p)
            one = ((byte >> _U(7 - bit)) & _U(1)).astype(bool)
            out += np.log10(np.where(one, p, 1 - p))
        return out


def top_levels(model: DataFrame) -> tuple:
    """Depths 1 and 0: (node, KT estimate, beta) of each; at most 256 * 255 rows come to the driver."""

    def near(batches):
        for b in batches:
            for g, c in zip(b.column("grams").to_pylist(), b.column("counts").to_pylist()):
                key, zero, one, below = Tree(np.frombuffer(g, _U), np.frombuffer(c, np.int64)).near
                yield pa.RecordBatch.from_pydict({"key": key.astype(np.int64), "zero": zero, "one": one, "below": below})

    rows = model.mapInArrow(near, "key long, zero long, one long, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")])
    t = rows.orderBy("key").toPandas()
    key, zero, one, below = (t[c].to_numpy() for c in ("key", "zero", "one", "below"))
    out = []
    for _ in (1, 0):
        kt, half = log_kt(zero, one), np.log(0.5)
        weighted = np.logaddexp(half + kt, half + below)
        out.append((key.astype(_U), (one + 0.5) / (zero + one + 1.0), np.exp(half + kt - weighted)))
        key, at = np.unique(key & 255, return_inverse=True)
        zero, one, below = (np.bincount(at, weights=x, minlength=len(key)) for x in (zero, one, weighted))
    return tuple(out)


_ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("vocabulary", pa.int64())])
_ROW_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, known double, score double, n_bytes long, vocabulary long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs``
    (doc_id, text, held_out); rows whose held_out is false are trained on."""
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    salts = 1 + n_bytes // 4_000_000_000
    near = int(np.clip(n_bytes // 8_000_000, 16, 4096))
    far = buckets_for(n_bytes)
    model = stored(gram_counts(docs.filter("NOT held_out"), near, salts), "grams")
    top = spark.sparkContext.broadcast(top_levels(model))
    end = mix(np.array([END], _U))

    def unpack(table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        w = Words(table.column("text"), lower=True)
        h = w.hashes()
        train = np.array([x is False for x in table.column("held_out").to_pylist()])
        words = np.append(h, np.repeat(end, len(w.count)))
        doc = np.append(w.doc, np.arange(len(w.count)))
        keys, at = np.unique(words, return_inverse=True)
        stream = Stream(w)
        return table, w, keys, at, doc, np.bincount(at, weights=train[doc], minlength=len(keys)), stream, np.unique(stream.grams)

    def send(table):
        unit = table.column("unit")[0].as_py()
        _, _, keys, _, _, counts, _, grams = unpack(table)
        order, names, cut = _deal(keys, far)
        keys, counts = keys[order], counts[order].astype(np.uint32)
        bucket = _near(grams, near)
        by = np.argsort(bucket, kind="stable")
        near_names, near_cut = np.unique(bucket[by], return_index=True)
        near_cut, grams = np.append(near_cut, len(by)), grams[by]
        out = {"bucket": [*names.tolist(), *(far + near_names * salts + unit % salts).tolist()], "keys": [keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] + [grams[a:b].tobytes() for a, b in zip(near_cut[:-1], near_cut[1:])]}
        out["counts"] = [counts[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] + [b""] * len(near_names)
        return pa.Table.from_pydict(out | {"unit": [unit] * len(out["bucket"])}, schema=_SENT)

    def reply(table, grams):
        keys, units = [np.frombuffer(x, _U) for x in table.column("keys").to_pylist()], table.column("unit").to_pylist()
        if not keys:
            return pa.Table.from_pylist([], schema=_BACK)
        bucket = table.column("bucket")[0].as_py()
        if bucket < far:
            totals = add_up(keys, [np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()], units)
            flat = np.concatenate(keys)
            first = np.zeros(len(flat), np.int64)
            first[np.unique(flat, return_index=True)[1]] = 1
            out = [2 * t + f * (t > 0) for t, f in zip(totals, np.split(first, np.cumsum([len(k) for k in keys])[:-1]))]
        else:
            asked = np.unique(np.concatenate(keys))
            model = [np.concatenate([np.frombuffer(x, t) for x in grams.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in (("grams", _U), ("counts", np.int64))]
            chance = Tree(*model).chances(asked, top.value)
            out = [chance[np.searchsorted(asked, k)].astype(np.float32) for k in keys]
        return pa.Table.from_pydict({"unit": units, "bucket": [bucket] * len(units), "totals": [x.tobytes() for x in out]}, schema=_BACK)

    def receive(table, back):
        unit = table.column("unit")[0].as_py()
        table, w, keys, at, doc, _, stream, grams = unpack(table)
        got = dict(zip(back.column("bucket").to_pylist(), back.column("totals").to_pylist()))
        order, names, cut = _deal(keys, far)
        totals = np.zeros(len(keys), np.int64)
        for name, a, b in zip(names.tolist(), cut[:-1], cut[1:]):
            totals[order[a:b]] = np.frombuffer(got[name], np.int64)
        bucket = _near(grams, near)
        chance = np.zeros(len(grams))
        for name in np.unique(bucket).tolist():
            chance[bucket == name] = np.frombuffer(got[far + name * salts + unit % salts], np.float32)
        n = len(w.count)
        count = totals >> 1
        add = lambda x: np.bincount(doc, weights=x[at], minlength=n)
        parts = np.add.reduceat(chance[np.searchsorted(grams, stream.grams)], stream.first[:-1]) if n else np.zeros(0)
        new = np.zeros(n, np.int64)
        new[:1] = int((totals & 1).sum())
        return pa.Table.from_arrays([table.column("doc_id"), table.column("held_out"), pa.array(w.count.astype(np.int64) + 1), pa.array(add(count > 0).astype(np.int64)), pa.array(add(np.log10(count + 0.5))), pa.array(parts), pa.array(stream.size.astype(np.int64)), pa.array(new)], schema=_ROW)

    units = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out").withColumn("unit", unit_column(units_for(n_bytes), "doc_id", "text"))
    sent = units.groupBy("unit").applyInArrow(send, SENT)
    least = (F.lit(far) + F.col("bucket") * salts).cast("int")
    shared = model.select("grams", "counts", F.explode(F.sequence(least, least + salts - 1)).alias("bucket"))
    back = sent.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(reply, BACK)
    rows = stored(units.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(receive, _ROW_DDL), "scores")
    tokens, vocabulary = rows.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.sum("vocabulary")).first()
    tokens, vocabulary = tokens or 0, vocabulary or 0
    base = F.col("known") - F.col("n_tokens") * F.log10(F.lit(tokens + 0.5 * (vocabulary + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * np.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(folded() % 5 == 1, F.lit(True)).alias("held_out"))
    return score(docs)
