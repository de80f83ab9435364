"""Document fingerprints from prefix polynomial hashes.

The prefix sums of code * BASE ** position modulo the prime 2**61 - 1 give the hash of any span of a text in a constant
number of steps: the difference of two prefix sums, divided by the power at the span's start.  So equal spans are told without
looking at them, and the longest common extension of two places is found by binary search on its length.

A fingerprint is text: the length, the hash of the whole, the ``SAMPLE`` least hashes of all windows of ``WINDOW`` code points,
and hashes of the beginnings and endings of fixed lengths (1 to 8, then four to an octave).  The likeness of two fingerprints
estimates the share of code points in common: 1 where length and whole agree, else the greater of what their common beginning and ending
make up, found by binary search over the fixed lengths, and of Dice's coefficient of the windows.

The order of documents is laid over the cluster in blocks between keys drawn from the table; a block gets the first
document of the next one as a guest, so texts are shuffled once and each task passes over its block in order,
holding some ``HELD`` code points (or one text) at a time.

Defined results: null text is empty; an empty text is like empty ones (1) and unlike all others (0); a text shorter than a window is one window; null doc_ids come after all
others; rows with one doc_id are in order of a hash of their texts; a document that is alone is its own next one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import PRIME, between, documents, mix, powers, running, times

#: Fixed for all time, as fingerprints are compared across runs.
BASE = 0x12D4B39D5A1C6F7B
WINDOW, SAMPLE = 16, 32
#: Code points that a task works on at once, UTF-8 bytes of a block of the order, and rows drawn for each block (most blocks in all: ``BLOCKS``).
HELD, BLOCK_BYTES, DRAWN, BLOCKS = 500_000, 16_000_000, 20, 50_000

_U = np.uint64


class Prefixes:
    """Prefix sums over texts laid end to end."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(_U) + _U(1)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        self.sums = running(times(codes, powers(BASE, len(codes))))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end), the same wherever it stands."""
        start = np.asarray(start, np.int64)
        return times(between(self.sums, start, end), powers(pow(BASE, -1, PRIME), int(start.max(initial=0)) + 1)[start])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of ``size`` code points from ``a`` and from ``b`` on are equal."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        return times(between(self.sums, a, a + size), powers(BASE, int((b - a).max(initial=0)) + 1)[b - a]) == between(self.sums, b, b + size)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of ``a`` and ``b``, ``most`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _rungs(most: int) -> list[int]:
    """Lengths of the beginnings and endings that a fingerprint holds, up to ``most``."""
    out = [k for k in range(1, 9) if k <= most]
    step = 2
    while out and out[-1] >= 8 and out[-1] + step <= most:
        out.append(out[-1] + step)
        step *= 2 if out[-1] == 8 * step else 1
    return out


def _least(values: np.ndarray) -> np.ndarray:
    """The ``SAMPLE`` least distinct values, ascending."""
    take = SAMPLE
    while take < len(values):
        found = np.unique(np.partition(values, take)[:take])
        if len(found) >= SAMPLE:
            return found[:SAMPLE]
        take *= 4
    return np.unique(values)[:SAMPLE]


def prints(p: Prefixes) -> list[str]:
    """The fingerprint of each text of ``p``."""
    start, end = p.at[:-1], p.at[1:]
    n = int(p.at[-1])
    first = np.arange(max(0, n - WINDOW + 1))
    windows = (mix(p.spans(first, first + WINDOW)) >> _U(32)).astype(np.uint32)
    whole = p.spans(start, end)
    rungs = np.array(_rungs(int((end - start).max(initial=0))), np.int64)
    fits = np.searchsorted(rungs, end - start, "right")
    take = np.concatenate([rungs[:k] for k in fits]) if len(fits) else rungs
    of = np.repeat(np.arange(len(fits)), fits)
    ends = [(mix(p.spans(a, b)) >> _U(48)).astype(">u2") for a, b in ((start[of], start[of] + take), (end[of] - take, end[of]))]
    at = np.concatenate([[0], np.cumsum(fits)])
    out = []
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        if b - a >= WINDOW:
            sample = _least(windows[a : b - WINDOW + 1])
        else:
            sample = (mix(whole[k : k + 1]) >> _U(32)) if b > a else np.zeros(0)
        out.append(".".join([f"{b - a:x}", f"{int(whole[k]):016x}", sample.astype(">u4").tobytes().hex(), *[x[at[k] : at[k + 1]].tobytes().hex() for x in ends]]))
    return out


def _common(a: str, b: str) -> int:
    """Index of the last of ascending lengths at which two texts still agree, by binary search; 0: none."""
    low, high = 0, min(len(a), len(b)) // 4
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[4 * mid - 4 : 4 * mid] == b[4 * mid - 4 : 4 * mid] else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """Estimated share of code points that the texts of two fingerprints have in common."""
    (na, wa, sa, pa_, ea), (nb, wb, sb, pb, eb) = a.split("."), b.split(".")
    na, nb = int(na, 16), int(nb, 16)
    if (na, wa) == (nb, wb):
        return 1.0
    if not na or not nb:
        return 0.0
    rungs = [0, *_rungs(min(na, nb))]
    ends = min(min(na, nb), rungs[_common(pa_, pb)] + rungs[_common(ea, eb)]) / max(na, nb)
    one, two = ({s[k : k + 8] for k in range(0, len(s), 8)} for s in (sa, sb))
    least = sorted(one | two)[:SAMPLE]
    both = sum(x in one and x in two for x in least) / len(least)
    return max(ends, 2 * both / (1 + both))


def with_likeness(rows: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """``rows`` with the likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else likeness(u, v) for u, v in zip(x, y)], dtype="float64")

    return rows.withColumn(out, alike(a, b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            for ids, texts in _held(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints(Prefixes(texts)), pa.string())], schema=schema)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _held(rows):
    """(ids, texts) of some ``HELD`` code points each."""
    ids, texts, size = [], [], 0
    for i, t in rows:
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= HELD:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def common_extensions(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a_text, a_at, b_text, b_at, ...) with ``extension``: how far both texts agree from these 0-based code points on; null where either is null or lies outside."""

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("a_text", "a_at", "b_text", "b_at")]
            out = []
            for s, i, t, j in zip(*cols):
                if None in (s, i, t, j) or not (0 <= i <= len(s) and 0 <= j <= len(t)):
                    out.append(None)
                    continue
                p = Prefixes([s, t])
                out.append(int(p.extension(np.array([i]), np.array([len(s) + j]), [min(len(s) - i, len(t) - j)])[0]))
            yield b.append_column("extension", pa.array(out, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{kinds}, extension long")


_KEY = np.dtype([("none", "?"), ("id", "<i8"), ("tie", "<i8")])


def _keys(rows) -> np.ndarray:
    return np.array([(i is None, i or 0, t) for i, t in rows], _KEY)


def in_order(docs: DataFrame) -> DataFrame:
    """(block, guest, doc_id, text), sorted within partitions: each block of the order of doc_ids is in one partition, followed by the first documents of the next block as guests.

    The driver holds a key for each block, and ``DRAWN`` to choose it from.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    if rows.isEmpty():
        return rows.select(F.lit(0).alias("block"), F.lit(0).alias("guest"), "doc_id", "text")
    n, size, least = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.min(key)).first()
    blocks = min(BLOCKS, max(1, -(-size // BLOCK_BYTES)))
    drawn = rows.sample(min(1.0, blocks * DRAWN / n), 12).select("doc_id", "tie").collect() if blocks > 1 else []
    drawn = np.unique(np.sort(_keys([(r["doc_id"], r["tie"]) for r in drawn])))
    starts = np.unique(np.concatenate([_keys([(least["doc_id"], least["tie"])]), drawn[np.arange(1, blocks) * len(drawn) // blocks] if len(drawn) else drawn]))

    @F.pandas_udf("array<bigint>")
    def places(none: pd.Series, doc_id: pd.Series, tie: pd.Series) -> pd.Series:
        """A row's block, and for the first of a block also the one before, as block * 2 + guest."""
        own = np.empty(len(tie), _KEY)
        own["none"], own["id"], own["tie"] = none, doc_id, tie
        block = np.maximum(np.searchsorted(starts, own, "right") - 1, 0)
        first = starts[block] == own
        return pd.Series([[2 * b] + [2 * ((b - 1) % len(starts)) + 1] * f for b, f in zip(block.tolist(), first.tolist())])

    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    dealt = rows.withColumn("place", F.explode(places(F.col("doc_id").isNull(), number, F.col("tie"))))
    dealt = dealt.withColumns({"block": F.floor(F.col("place") / 2), "guest": F.col("place") % 2}).drop("place")
    return dealt.repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_last(), "tie").drop("tie")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_EDITED = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in EDITED.split(", "))])


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows (block, guest, doc_id, text) that their next one in the block follows."""
    texts = [r[3] for r in rows]
    own = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
    edited = []
    for k in own:
        cut = len(texts[k]) // 4
        edited.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
    p = Prefixes(texts + edited)
    made = prints(p)
    after, size = np.arange(len(own)) + len(texts), np.diff(p.at)
    at = np.array(own, np.int64)
    common = [p.extension(p.at[at], p.at[to], np.minimum(size[at], size[to])) for to in (after, at + 1)]
    columns = [
        [rows[k][2] for k in own], size[at], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [made[k] for k in own], made[len(texts) :],
        [likeness(made[k], made[j]) for k, j in zip(own, after)], [likeness(made[k], made[k + 1]) for k in own], *common,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITED)], schema=_EDITED)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """``EDITED`` for each document: its last quarter is replaced by as much of the next document's beginning."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text")]):
                if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                    continue  # further guests of the block
                held.append(row)
                size += len(row[3])
                if size >= HELD and len(held) > 1:
                    yield _compared(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield _compared(held)

    return in_order(docs).mapInArrow(run, EDITED)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
