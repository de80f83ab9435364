"""Quality scores without hand labels: a weak-label model and a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on each text.  Expectation-maximisation over the table of vote
patterns (at most 3 ** 8 rows, whatever the corpus) estimates how accurate each heuristic is and what share of
texts is good, which gives every pattern a posterior.  A logistic scorer over hashed words and a few shape
features then learns the posteriors from a sample of at most ``ROWS`` distinct texts, so that it also judges texts on which
the heuristics are silent.  Votes, patterns and scores cover whole texts of all rows, and so does training: sampled
rows reach the driver as shape features and shares of hashed words, at most ``2 ** BITS`` of them, however long.

Defined results: a null text counts as empty; a text without words scores 0 and is not kept; repeated rows get the
same score; with no rows the scorer is empty; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import Words, byte_slices, documents, mix

#: Distinct texts of the training sample, and their UTF-8 bytes together.
ROWS, SIZE = 3_000, 64_000_000
#: Hashed word features.
BITS = 16
#: Heuristics (name, feature, low, high, vote under low, vote over high; 1 good, -1 bad, 0 none); the first group
#: looks for one kind of junk each and is silent otherwise, the second speaks for ordinary prose.
VOTES = (
    ("symbols", 0, 0.0, 0.06, 0, -1),
    ("capitals", 1, 0.0, 0.40, 0, -1),
    ("bars", 2, 0.0, 0.08, 0, -1),
    ("repeats", 3, 0.0, 0.15, 0, -1),
    ("sentences", 4, 0.02, 0.05, -1, 1),
    ("word_length", 5, 3.0, 12.0, -1, -1),
    ("variety", 6, 0.30, 1.0, -1, 0),
    ("plain_words", 7, 0.75, 0.90, -1, 1),
)
#: How much more a bad vote counts than a good one in the start of the estimation.
CAUTION = 3.0
FEATURES = 8


def features(w: Words) -> np.ndarray:
    """(text x feature) shape measures of whole texts, from byte classes and word hashes."""
    n = len(w.count)
    words = np.maximum(1, w.count)
    size = np.maximum(1, np.diff(w.offsets))
    add = lambda flags: np.append(0, np.cumsum(flags))
    share = lambda flags: np.diff(add(flags)[w.offsets])
    upper, lower = (w.raw >= 65) & (w.raw <= 90), (w.raw >= 97) & (w.raw <= 122)
    letters = share(upper) + share(lower)
    kinds = np.zeros(256, bool)
    kinds[[ord(c) for c in "#$%&*+<=>@^_`{}~\\!"]] = True
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    hs, ds = h[order], w.doc[order]
    first = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])) if len(h) else np.zeros(0, bool)
    ends = (w.raw[w.end - 1] == 46) | (w.raw[w.end - 1] == 63) if len(h) else np.zeros(0, bool)
    bars = (w.end - w.start == 1) & (w.raw[w.start] == 124) if len(h) else np.zeros(0, bool)
    per = lambda flags: np.bincount(w.doc, weights=flags, minlength=n) / words
    out = np.zeros((n, FEATURES))
    out[:, 0] = share(kinds[w.raw]) / size
    out[:, 1] = share(upper) / np.maximum(1, letters)
    out[:, 2] = per(bars)
    out[:, 3] = per(again)
    out[:, 4] = per(ends)
    out[:, 5] = np.bincount(w.doc, weights=w.end - w.start, minlength=n) / words
    # distinct words against what a text of this length would have
    out[:, 6] = np.minimum(1.0, np.bincount(ds, weights=first, minlength=n) / words * np.maximum(1.0, np.log10(words)) / 2)
    # letters throughout but for one mark at most
    letter = upper | lower | (w.raw >= 128)
    inside = add(letter)[w.end] - add(letter)[w.start]
    out[:, 7] = per((inside > 0) & (w.end - w.start - inside <= 1))
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """(text x heuristic) votes 1 good, -1 bad, 0 none."""
    out = np.zeros((len(x), len(VOTES)), np.int8)
    for k, (_, feature, low, high, under, over) in enumerate(VOTES):
        v = x[:, feature]
        out[:, k] = np.where(v > high, over, np.where(v < low, under, 0))
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(VOTES))) % 3 - 1


def weak_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of good for each pattern, by expectation-maximisation from a weighted majority start."""
    v = votes_of(patterns)
    total = np.maximum(counts.sum(), 1)
    post = 1 / (1 + np.exp(-((v > 0).sum(axis=1) - CAUTION * (v < 0).sum(axis=1))))
    for _ in range(rounds):
        weight = np.stack([counts * post, counts * (1 - post)])
        prior = np.clip(weight[0].sum() / total, 0.02, 0.98)
        # chance of each vote (bad, none, good) for good and for bad texts, smoothed
        table = np.stack([[weight @ (v[:, k] == s) + 1.0 for s in (-1, 0, 1)] for k in range(v.shape[1])])
        table /= table.sum(axis=1, keepdims=True)
        log = np.log(table)
        at = v + 1
        score = np.stack([sum(log[k, at[:, k], c] for k in range(v.shape[1])) for c in (0, 1)])
        odds = np.log(prior) - np.log(1 - prior) + score[0] - score[1]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature number of every word."""
    return w.doc, (mix(w.hashes()) >> np.uint64(64 - BITS)).astype(np.int64)


def condensed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature number and share of the text's words, once for each pair of text and feature."""
    doc, feature = hashed(w)
    pair, times = np.unique((doc.astype(np.int64) << BITS) | feature, return_counts=True)
    doc = pair >> BITS
    return doc, pair & ((1 << BITS) - 1), times / np.maximum(1, w.count)[doc]


class Scorer:
    """Logistic regression over mean hashed words and standardised shape features.

    ``x`` holds the shape features of the training texts; ``doc``, ``feature`` and ``share`` their condensed words.
    """

    def __init__(self, x: np.ndarray, doc: np.ndarray, feature: np.ndarray, share: np.ndarray, target: np.ndarray, rounds: int = 150):
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.word, self.shape, self.bias = np.zeros(1 << BITS), np.zeros(FEATURES), 0.0
        z = self._scaled(x)
        for _ in range(rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-self._raw(z, doc, feature, share, len(x))))
            error = (target - p) / len(x)
            self.word += 40.0 * (np.bincount(feature, weights=error[doc] * share, minlength=1 << BITS) - 1e-6 * self.word)
            self.shape += 1.0 * (error @ z)
            self.bias += 1.0 * error.sum()

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.sd, -4, 4)

    def _raw(self, z, doc, feature, share, n):
        return np.bincount(doc, weights=self.word[feature] * share, minlength=n) + z @ self.shape + self.bias

    def score(self, w: Words) -> np.ndarray:
        doc, feature = hashed(w)
        raw = self._raw(self._scaled(features(w)), doc, feature, 1 / np.maximum(1, w.count)[doc], len(w.count))
        return np.where(w.count > 0, 1 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id and vote pattern of each row."""

    def run(batches):
        for b in byte_slices(batches, "text", 4_000_000):
            v = votes(features(Words(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pattern_of(v))], ["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern long")


def training(docs: DataFrame) -> DataFrame:
    """Vote pattern, shape features and condensed words of each row's whole text; ``rank`` and ``tie`` pass through."""

    def run(batches):
        for b in byte_slices(batches, "text", 4_000_000):
            w = Words(b.column("text"))
            x = features(w)
            doc, feature, share = condensed(w)
            at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32())
            columns = [
                b.column("rank"), b.column("tie"), pa.array(pattern_of(votes(x))), pa.array(list(x), pa.list_(pa.float64())),
                pa.ListArray.from_arrays(at, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(at, pa.array(share)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rank", "tie", "pattern", "x", "feature", "share"])

    return docs.select("rank", "tie", "text").mapInArrow(run, "rank long, tie long, pattern long, x array<double>, feature array<int>, share array<double>")


def sample(docs: DataFrame, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """(rank, tie, text) of at most ``rows`` distinct texts of ``size`` bytes together: those with the least hashes, so that reruns agree.

    A text counts once however often it occurs; one that is longer than what is left of ``size`` is left out whole.
    """
    space = 1_000_000
    drawn = docs.select("text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(space)).alias("rank"), F.xxhash64("text").alias("tie"))
    n = drawn.agg(F.approx_count_distinct("tie")).first()[0]
    drawn = drawn.filter(F.col("rank") <= space * min(1.0, 1.25 * rows / max(1, n)))
    sizes = drawn.groupBy("rank", "tie").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).filter(F.col("size") <= size).orderBy("rank", "tie").limit(rows)
    chosen = []
    for r in sizes.collect():  # at most ``rows`` numbers
        if r["size"] <= size:
            chosen.append((r["rank"], r["tie"]))
            size -= r["size"]
    few = docs.sparkSession.createDataFrame(chosen, "rank long, tie long")
    return drawn.join(F.broadcast(few), ["rank", "tie"]).groupBy("rank", "tie").agg(F.first("text").alias("text"))


def classify(docs: DataFrame, rows: int = ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and kept for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    counts = vote_patterns(docs).groupBy("pattern").count().toPandas()
    patterns, n = counts["pattern"].to_numpy(np.int64), counts["count"].to_numpy(float)
    post = dict(zip(patterns.tolist(), weak_labels(patterns, n).tolist())) if len(counts) else {}
    t = training(sample(docs, rows)).orderBy("rank", "tie").toArrow().combine_chunks()
    flat = lambda name: pc.list_flatten(t[name]).combine_chunks().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(t.num_rows), pc.list_value_length(t["feature"]).to_numpy())
    target = np.array([post[p] for p in t["pattern"].to_pylist()])
    scorer = spark.sparkContext.broadcast(Scorer(flat("x").reshape(-1, FEATURES), doc, flat("feature"), flat("share"), target))

    def run(batches):
        for b in byte_slices(batches, "text", 4_000_000):
            score = scorer.value.score(Words(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
