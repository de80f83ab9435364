"""Pieces that the corpus operators share: scratch tables, vectorised hashing of words modulo a prime.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All hashing works on the UTF-8 bytes of an
Arrow column at once with NumPy, so that Python never loops over words.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is set only on one machine and where none is named (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named


def scratch_dir(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this application; it can go once the results are written."""
    return f"{checkpoint_dir(spark).rstrip('/')}/popspark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables: call it after the last result is written, as results read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_for(rows: int) -> int:
    """Tasks for a step over so many narrow rows, where the session's number of shuffle partitions is meant for wide ones."""
    return max(16, -(-rows // 100_000))


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, by ``parts`` tasks at most, and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes units and buckets, never limits them."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def folded() -> F.Column:
    """crc32 of the decimal document id, as the contracts fix folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut or pass on batches so that the texts of each hold about ``most`` bytes, one text at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, stop - at)
            at = stop


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


#: Hashes are polynomials modulo this prime; the bases are fixed random residues.
PRIME = 2**61 - 1
_P, _LOW30, _LOW31, _LOW32 = _U(PRIME), _U(2**30 - 1), _U(2**31 - 1), _U(2**32 - 1)
_BASES = (0x0C6F3A3D8E1B59D7, 0x15D2B7461F9C08EB)
_ODD = 0x9E3779B97F4A7C15
_WHOLE = (0x0A91E5C73B604DF3, 0x1B47C02D96F5E8A1)


def fold(x: np.ndarray) -> np.ndarray:
    """Residues of numbers below 2**64."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


#: Numbers handled at once, so that what is in between stays in a core's cache.
CACHED = 1 << 14


def times(a: np.ndarray, b) -> np.ndarray:
    """Products of residues."""
    b = np.broadcast_to(np.asarray(b, _U), a.shape)
    if len(a) > CACHED:
        out = np.empty(len(a), _U)
        for at in range(0, len(a), CACHED):
            out[at : at + CACHED] = times(a[at : at + CACHED], b[at : at + CACHED])
        return out
    ah, al, bh, bl = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    mid, low = ah * bl + al * bh, al * bl
    return fold(_U(2) * ah * bh + (mid >> _U(30)) + ((mid & _LOW30) << _U(31)) + (low & _P) + (low >> _U(61)))


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    """Residues times 2**bits."""
    return ((x & _U(2 ** (61 - bits) - 1)) << _U(bits)) | (x >> _U(61 - bits))


KEPT = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``n`` powers from 1 on; a worker keeps up to ``KEPT`` of each base."""
    kept = _POWERS.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, times(out, pow(base, len(out), PRIME))])
    if len(out) <= KEPT:
        _POWERS[base] = out
    return out[:n]


def running(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the upper and lower halves of residues, for ``between``."""
    high, low = np.zeros(len(terms) + 1, _U), np.zeros(len(terms) + 1, _U)
    np.cumsum(terms >> _U(32), out=high[1:])
    np.cumsum(terms & _LOW32, out=low[1:])
    return high, low


def between(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Residue of the terms from ``start`` up to ``end``; running sums may have wrapped meanwhile."""
    high, low = (x[end] - x[start] for x in sums)
    return fold(turned(fold(high), 32) + fold(low))


#: Spans of so few words are hashed modulo 2**64: their words' hashes are mixed residues, and strings that such a polynomial
#: confuses whatever its odd base have 2**10 symbols or more.
SHORT = 32


def _short(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    n = len(values)
    up, down = np.full(n + 1, base | 1, _U), np.full(n + 1, pow(base | 1, -1, 2**64), _U)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def _windows(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same at every place; spans may overlap."""
    if int((end - start).max(initial=0)) <= SHORT:
        return _short(values, start, end, base)
    sums = running(times(fold(values), powers(base, len(values))))
    down = powers(pow(base, -1, PRIME), len(values) + 1)
    out = np.empty(len(start), _U)
    for at in range(0, len(start), CACHED):
        own = slice(at, at + CACHED)
        out[own] = mix(times(between(sums, start[own], end[own]), down[start[own]]))
    return out


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The same for ascending spans that do not overlap: exponents count from each span's start."""
    size = end - start
    ends = np.cumsum(size)
    most = int(size.max(initial=0))
    up = powers(base, most + 1)
    parts = up >> _U(31), up & _LOW31
    out, k = np.empty(len(start), _U), 0
    while k < len(start):  # some thousand values at a time, one span at least
        j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 4 * CACHED, "right")))
        n, first = size[k:j], start[k]
        stop = np.cumsum(n)
        begin = stop - n
        at = np.arange(stop[-1]) - np.repeat(begin, n)
        x = values[first : end[j - 1]]
        if len(x) > len(at):
            x = x[at + np.repeat(start[k:j] - first, n)]
        x = x.astype(_U) + _U(1) if values.dtype == np.uint8 else fold(x)
        if values.dtype == np.uint8 and most < 1 << 22:  # a span's sum of 9 + 31 + 22 bits fits
            high, low = (np.append(_U(0), np.cumsum(x * part[at])) for part in parts)
            out[k:j] = mix(fold(turned(fold(high[stop] - high[begin]), 31) + fold(low[stop] - low[begin])))
        else:
            out[k:j] = mix(between(running(times(x, up[at])), begin, stop))
        k = j
    return out


class Words:
    """Words of a column of texts: byte bounds, document of each word, first word of each document, hashes."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        self.raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = _LOWER[self.raw] if lower else self.raw
        gap = _SPACE[self.raw]
        edge = np.zeros(len(gap) + 1, bool)
        edge[self.offsets] = True
        begins, ends = ~gap, ~gap
        if len(gap):
            begins[1:] &= gap[:-1] | edge[1:-1]
            ends[:-1] &= gap[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # of length n + 1
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of each word; ``which`` chooses one of two independent ones."""
        if which not in self._hashes:
            self._hashes[which] = _spans(self.data, self.start, self.end, _BASES[which])
        return self._hashes[which]

    def joined(self, hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each word on; where fewer follow, of those that are left."""
        at = np.arange(len(hashes))
        return _windows(hashes, at, np.minimum(at + size, len(hashes)), _BASES[1 - which])

    def rough(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Cheaper hash of the ``size`` words from each word on, equal for equal windows; crafted windows may share it, so it may only propose."""
        at = np.arange(len(hashes))
        return _short(hashes, at, np.minimum(at + size, len(hashes)), _ODD)

    def spans(self, hashes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``at`` up to ``end``."""
        return _windows(hashes, at, end, _BASES[1])

    def whole(self, which: int = 0) -> np.ndarray:
        """Hash of each document's word sequence, over words hashed by ``which`` too."""
        return _spans(self.hashes(which), self.first[:-1], self.first[1:], _WHOLE[which])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
