"""Removal of passages that repeat, found by level-wise doubling.

A window of ``size`` words repeats only if every shorter window inside it does.  So windows of ``first`` words are
counted over the corpus; only places where all of them repeat are looked at with windows of twice that length, and
so on up to ``size``.  Documents without a place left are done and leave; after the first level little text moves.
Below the last length 32-bit hashes are enough, as a collision only lets a candidate through; at the last length
128 bits decide.  There each unit of documents names the first document that holds a window, the bucket finds the
first of all, and every other occurrence removes the words it covers.  Documents are in order of doc_id, then of a
hash of their texts.

Defined results: null text counts as empty; documents with fewer words than a window stay as they are (their
words joined by one space); null doc_ids come last; rows that share a doc_id, or have none, count as documents of their own,
in the order of xxhash64(5, text), so that it does not matter how rows are dealt; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import Words, documents, stored, text_bytes
from popspark.llm.exchange import buckets_for, exchange, unit_column, units_for

SIZE = 20
FIRST = 5

ROW = "doc_id long, n_words long, n_removed long, kept_sha256 string, tie long, text string, starts binary"
_ROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("tie", pa.int64()), ("text", pa.string()), ("starts", pa.binary())])


class Places:
    """The documents of a unit in order, their words, and where windows of ``size`` words may still repeat."""

    def __init__(self, table: pa.Table, size: int):
        self.table = table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.words = w = Words(table.column("text"))
        total = len(w.start)
        starts = table.column("starts").to_pylist()
        self.candidate = np.zeros(total + size, bool)
        if starts and starts[0] is None:
            room = w.first[1:][w.doc] - np.arange(total) if total else np.zeros(0, np.int64)
            self.candidate[:total] = room >= size
        else:
            for at, n, s in zip(w.first.tolist(), w.count.tolist(), starts):
                self.candidate[at : at + n] = np.unpackbits(np.frombuffer(s, np.uint8), count=n)
        self.size = size

    def needed(self, length: int) -> np.ndarray:
        """Where windows of ``length`` words lie inside a candidate."""
        total = np.append(0, np.cumsum(self.candidate))
        at = np.arange(len(self.words.start))
        return np.flatnonzero(total[at + 1] > total[np.maximum(0, at - (self.size - length))])

    def narrow(self, length: int, at: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Candidates all of whose windows of ``length`` words repeat."""
        once = np.zeros(len(self.candidate) + 1, np.int64)
        once[at[~repeats] + 1] = 1
        once = np.cumsum(once)
        here = np.flatnonzero(self.candidate)
        left = np.zeros_like(self.candidate)
        left[here[once[here + self.size - length + 1] == once[here]]] = True
        return left

    def hashes(self, length: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        return self.words.joined(self.words.hashes(which), length, which)[at]

    def proposals(self, length: int, at: np.ndarray) -> np.ndarray:
        """32-bit keys of windows; equal windows have equal keys, and the last length tells the others apart."""
        return self.words.rough(self.words.hashes(), length)[at] >> np.uint64(32)

    def rows(self, removed: np.ndarray, pending: np.ndarray | None = None, left: np.ndarray | None = None) -> pa.Table:
        """A finished row for each document, or its text and candidates where it is pending."""
        w, n = self.words, len(self.words.count)
        keep = ~removed
        nth = np.cumsum(keep)
        before = np.append(0, nth)[w.first[:-1]]
        mask, out = np.zeros(len(w.raw) + 1, np.int8), w.raw.copy()
        np.add.at(mask, w.start[keep], 1)
        np.add.at(mask, w.end[keep], -1)
        mask = np.cumsum(mask[:-1]).astype(bool)
        later = keep & (nth > before[w.doc] + 1) if len(keep) else keep
        out[w.start[later] - 1] = 32
        mask[w.start[later] - 1] = True
        ends = np.append(0, np.cumsum(mask))[w.offsets]
        text = out[mask].tobytes()
        sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        gone = np.bincount(w.doc, weights=removed, minlength=n).astype(np.int64)
        texts, starts = pa.nulls(n, pa.string()), [None] * n
        if pending is not None:
            texts = pc.if_else(pa.array(pending), self.table.column("text").combine_chunks().cast(pa.string()), pa.scalar(None, pa.string()))
            for i in np.flatnonzero(pending).tolist():
                starts[i] = np.packbits(left[w.first[i] : w.first[i + 1]]).tobytes()
        return pa.Table.from_arrays([self.table.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(gone), pa.array(sha, pa.string()), self.table.column("tie"), texts, pa.array(starts, pa.binary())], schema=_ROW)


def _level(rows: DataFrame, n_bytes: int, length: int, size: int) -> DataFrame:
    def items(table):
        p = Places(table, size)
        keys = p.proposals(length, p.needed(length))
        return np.unique(keys, return_counts=True)

    def answer(table, keys, totals):
        p = Places(table, size)
        at = p.needed(length)
        mine = np.searchsorted(keys, p.proposals(length, at))
        left = p.narrow(length, at, totals[mine] > 1 if len(at) else np.zeros(0, bool))
        pending = np.bincount(p.words.doc, weights=left[: len(p.words.doc)], minlength=len(p.words.count)) > 0
        return p.rows(np.zeros(len(p.words.doc), bool), pending, left)

    return exchange(rows.withColumn("unit", unit_column(units_for(n_bytes), "doc_id", "text")), buckets_for(n_bytes), items, answer, ROW, key_type=np.uint32, total_type=np.uint8)


_FIRST = np.dtype([("second", np.uint64), ("doc", np.int64), ("tie", np.int64)])


def _last_keys(p: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows are, their distinct hashes, each window's number among them, and the first window of each."""
    at = p.needed(p.size)
    both = np.empty(len(at), [("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = p.hashes(p.size, at), p.hashes(p.size, at, 1)
    order = np.lexsort((at, both["b"], both["a"]))
    ranked = both[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(at) else np.zeros(0, bool)
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    return at, ranked[new], number, order[new]


def _earliest(keys, values, units):
    """1 where a unit holds the first document of a window: least doc, then least tie."""
    sizes = [len(k) for k in keys]
    flat, val = np.concatenate(keys), np.concatenate(values)
    unit = np.repeat(units, sizes)
    order = np.lexsort((unit, val["tie"], val["doc"], val["second"], flat))
    f, v = flat[order], val["second"][order]
    out = np.zeros(len(flat), np.int64)
    out[order[np.append(True, (f[1:] != f[:-1]) | (v[1:] != v[:-1]))]] = 1
    return np.split(out, np.cumsum(sizes)[:-1])


def _final(rows: DataFrame, n_bytes: int, size: int) -> DataFrame:
    def items(table):
        p = Places(table, size)
        at, keys, _, first = _last_keys(p)
        values = np.empty(len(keys), _FIRST)
        values["second"] = keys["b"]
        ids = pc.fill_null(p.table.column("doc_id"), np.iinfo(np.int64).max).to_numpy()
        values["doc"] = ids[p.words.doc[at[first]]] if len(at) else 0
        values["tie"] = p.table.column("tie").to_numpy()[p.words.doc[at[first]]] if len(at) else 0
        return keys["a"], values

    def answer(table, keys, totals):
        p = Places(table, size)
        at, _, number, first = _last_keys(p)
        stays = np.zeros(len(at), bool)
        stays[first[totals == 1]] = True
        cover = np.zeros(len(p.words.doc) + 1, np.int64)
        again = at[~stays]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + size, -1)
        return p.rows(np.cumsum(cover[:-1]) > 0)

    units = rows.withColumn("unit", unit_column(units_for(n_bytes), "doc_id", "text"))
    return exchange(units, buckets_for(n_bytes), items, answer, ROW, sent_type=_FIRST, combine=_earliest, total_type=np.uint8)


def remove_repeats(docs: DataFrame, size: int = SIZE, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs`` (doc_id, text); ``size`` is ``first`` times a power of 2."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("starts"))
    rows = rows.withColumn("tie", F.xxhash64(F.lit(5), "text"))
    done, length = [], first
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    while length < size:
        level = stored(_level(rows, text_bytes(rows), length, size), f"windows-{length}")
        done.append(level.filter("text IS NULL").select(columns))
        rows = level.filter("text IS NOT NULL").select("doc_id", "tie", "text", "starts")
        length *= 2
    done.append(_final(rows, text_bytes(rows), size).select(columns))
    return reduce(DataFrame.unionByName, done)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i + unnest(range(20)) AS p FROM again)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
