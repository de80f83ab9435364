"""Counts of hashed items over a whole corpus, handed back to the documents that hold the items.

Rows are dealt by a hash into units of some megabytes of text.  A unit sends its distinct item hashes, packed as
binary columns, to buckets of the hash space; a bucket adds up what all units say and answers each unit in the
order in which the unit asked.  So an item costs 4 or 8 shuffled bytes instead of a row, a frequent item reaches
a bucket once for each unit and not once for each occurrence, and no task holds more than a unit or a bucket,
whose numbers grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popspark.llm.common import mix

UNIT_BYTES = 4_000_000
BUCKET_BYTES = 4_000_000

SENT = "bucket int, unit long, keys binary, counts binary"
BACK = "unit long, bucket int, totals binary"


def unit_column(n_units: int, *columns) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(41), *columns), F.lit(n_units))


def units_for(n_bytes: int) -> int:
    return max(1, -(-n_bytes // UNIT_BYTES))


def buckets_for(n_bytes: int) -> int:
    return max(1, -(-n_bytes // BUCKET_BYTES))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(20)) % np.uint64(buckets)


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by bucket, the buckets that occur, and where each starts (and the last ends)."""
    bucket = _bucket_of(keys, buckets).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    return order, names, np.append(first, len(keys))


_SENT = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())])


def add_up(keys: list[np.ndarray], counts: list[np.ndarray], units: list[int]) -> list[np.ndarray]:
    """For each unit's keys the sum of all units' counts."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.append(True, flat[1:] != flat[:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.concatenate(counts)[order])
    out = np.empty(len(flat), np.int64)
    out[order] = total[group]
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def exchange(
    units: DataFrame,
    buckets: int,
    items: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table],
    schema: str,
    key_type=np.uint64,
    sent_type=np.uint32,
    combine=add_up,
    total_type=np.uint32,
) -> DataFrame:
    """``answer(unit's rows, keys, totals)`` for each unit, where ``items(unit's rows)`` gives distinct keys and a value for each.

    ``combine`` gets, within a bucket, each unit's keys, values and number and returns the totals of each unit; by
    default it sums.  ``units`` needs a column ``unit``.  Both functions see the same rows in any order, so
    ``items`` must not depend on the order.
    """
    most = np.iinfo(total_type).max

    def send(table: pa.Table) -> pa.Table:
        keys, values = items(table)
        order, names, at = _deal(keys, buckets)
        keys, values = keys[order].astype(key_type), values[order].astype(sent_type)
        parts = [slice(a, b) for a, b in zip(at[:-1], at[1:])] if len(keys) else []
        unit = table.column("unit")[0].as_py()
        return pa.Table.from_pydict({"bucket": names if parts else [], "unit": [unit] * len(parts), "keys": [keys[p].tobytes() for p in parts], "counts": [values[p].tobytes() for p in parts]}, _SENT)

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, key_type) for x in table.column("keys").to_pylist()]
        values = [np.frombuffer(x, sent_type) for x in table.column("counts").to_pylist()]
        totals = combine(keys, values, table.column("unit").to_pylist())
        packed = [np.minimum(t, most).astype(total_type).tobytes() for t in totals]
        return pa.Table.from_pydict({"unit": table.column("unit"), "bucket": table.column("bucket"), "totals": packed}, _BACK)

    def receive(table: pa.Table, back: pa.Table) -> pa.Table:
        keys, _ = items(table)
        order, names, at = _deal(keys, buckets)
        got = dict(zip(back.column("bucket").to_pylist(), back.column("totals").to_pylist()))
        totals = np.empty(len(keys), total_type)
        for name, a, b in zip(names.tolist(), at[:-1], at[1:]) if len(keys) else ():
            totals[order[a:b]] = np.frombuffer(got[name], total_type)
        return answer(table, keys, totals)

    sent = units.groupBy("unit").applyInArrow(send, SENT)
    back = sent.groupBy("bucket").applyInArrow(add, BACK)
    return units.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(receive, schema)
