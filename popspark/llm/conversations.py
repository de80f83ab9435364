"""Repair of the role structure of conversations: generalised LR parsing with edits.

A grammar over role initials gives LR(0) states with one symbol of lookahead.  The parser keeps a graph-structured
stack: all stacks that some edits of the rows so far lead to, where those with one top state are merged into that of
least (cost, audit).  Each row may be kept, given another role or deleted, and empty rows may be inserted before and
after it; every edit costs, and its initial is appended to the audit.  No audit of an equal cost at the same top is
the beginning of another one (it would lack insertions, which cost), so the merged minimum is the minimum of the whole.

Rows are sorted by range over the cluster, so a conversation of any length is spread over tasks, each of which
passes over its rows once.  A conversation that lies within one task is done there.  One that reaches over the border
of a task, or has more rows than a block, becomes blocks: repeated rows are found by an aggregation over the blocks, each block
gives the least edits from every top to every top, these are chained in order, and the blocks write their
repaired rows.  A SHA-256 has to pass over a conversation's text in order, so it streams over packed blocks.

Defined results: a null role or text is one space; rows are ordered by turn (nulls first), role and text; a null
conv_id is a conversation of its own; an empty role has no initial, so it cannot be kept; a conversation without rows is
not known here (the query adds it); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import stored

#: Fixed values of the contract: productions (capitals are nonterminals, the first one is the start), roles, costs.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: A conversation's rows and UTF-8 bytes in one block.
BLOCK_ROWS, BLOCK_BYTES = 1000, 1_000_000


class Grammar:
    """LR states of productions, with reductions where the next symbol may follow."""

    def __init__(self, productions=GRAMMAR):
        self.productions = (("^", productions[0][0]), *productions)
        self.heads = {h for h, _ in self.productions}
        self.terminals = {x for _, body in productions for x in body} - self.heads
        self.goto: dict[tuple[int, str], int] = {}
        self.states = [self._closure({(0, 0)})]
        for n, items in enumerate(self.states):  # the list grows meanwhile
            for x in sorted({self._next(i) for i in items} - {None}):
                to = self._closure({(p, dot + 1) for p, dot in items if self._next((p, dot)) == x})
                if to not in self.states:
                    self.states.append(to)
                self.goto[n, x] = self.states.index(to)
        self.follow = self._follow()
        self.shift = lru_cache(1 << 16)(self._shift)
        self.accepts = lru_cache(1 << 16)(self._accepts)

    def _next(self, item):
        p, dot = item
        body = self.productions[p][1]
        return body[dot] if dot < len(body) else None

    def _closure(self, items) -> frozenset:
        items = set(items)
        while new := {(p, 0) for i in items for p, (h, _) in enumerate(self.productions) if h == self._next(i)} - items:
            items |= new
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        first: dict[str, set[str]] = {h: set() for h in self.heads}  # "" where the head may be empty
        follow: dict[str, set[str]] = {h: set() for h in self.heads}
        follow["^"] = {"$"}

        def begins(symbols: str) -> set[str]:
            out = set()
            for x in symbols:
                own = first.get(x, {x})
                out |= own - {""}
                if "" not in own:
                    return out
            return out | {""}

        size = -1
        while size != (size := sum(map(len, [*first.values(), *follow.values()]))):
            for h, body in self.productions:
                first[h] |= begins(body)
                for k, x in enumerate(body):
                    if x in self.heads:
                        rest = begins(body[k + 1 :])
                        follow[x] |= rest - {""} | (follow[h] if "" in rest else set())
        return follow

    def _reduced(self, stack: tuple, look: str):
        """The stack and all that reductions before the symbol ``look`` make of it."""
        todo, seen = [stack], set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            yield s
            for p, dot in self.states[s[-1]]:
                head, body = self.productions[p]
                if head != "^" and dot == len(body) and look in self.follow[head]:
                    rest = s[: len(s) - len(body)]
                    if (rest[-1], head) in self.goto:
                        todo.append((*rest, self.goto[rest[-1], head]))

    def _shift(self, stack: tuple, symbol: str) -> tuple:
        if symbol not in self.terminals:
            return ()
        return tuple((*s, self.goto[s[-1], symbol]) for s in self._reduced(stack, symbol) if (s[-1], symbol) in self.goto)

    def _accepts(self, stack: tuple) -> bool:
        return any((0, 1) in self.states[s[-1]] for s in self._reduced(stack, "$"))

    def tops(self) -> dict[int, tuple]:
        """A stack for each top state that shifts lead to."""
        found, todo = {0: (0,)}, [(0,)]
        while todo:
            s = todo.pop(0)
            for x in sorted(self.terminals):
                for to in self.shift(s, x):
                    if to[-1] not in found:
                        found[to[-1]] = to
                        todo.append(to)
        return found


#: A path is (cost, audit, roles, stack); ``roles`` has an initial for each edit, "-" for a deletion.
def _put(front: dict, path: tuple) -> bool:
    top = path[3][-1]
    if top in front and front[top] <= path:
        return False
    front[top] = path
    return True


def _inserted(g: Grammar, front: dict) -> dict:
    """``front`` with all that insertions reach."""
    todo = list(front.values())
    while todo:
        cost, audit, roles, stack = todo.pop()
        for x in ROLES:
            for to in g.shift(stack, x):
                path = (cost + INSERT, f"{audit}I", roles + x, to)
                if _put(front, path):
                    todo.append(path)
    return front


def parse(g: Grammar, rows: list[tuple[str, str]], stack: tuple = (0,)) -> dict:
    """Least paths by top state over rows of (initial, fault)."""
    front = _inserted(g, {stack[-1]: (0, "", "", stack)})
    for initial, fault in rows:
        new: dict = {}
        more = TRUNCATED if fault == "truncated" else 0
        for cost, audit, roles, s in front.values():
            _put(new, (cost + DELETE, f"{audit}D", f"{roles}-", s))
            if fault in ("blank", "duplicate"):
                continue
            for to in g.shift(s, initial):
                _put(new, (cost + more, f"{audit}K", roles + initial, to))
            for x in ROLES:
                for to in g.shift(s, x) if x != initial else ():
                    _put(new, (cost + more + REROLE, f"{audit}R", roles + x, to))
        front = _inserted(g, new)
    return front


def cheapest(g: Grammar, front: dict) -> tuple:
    return min(p for p in front.values() if g.accepts(p[3]))


def faults(roles: list[str], texts: list[str], known: set[int] = frozenset()) -> list[str]:
    """The first fault of each row, or ""; ``known`` are positions whose role and text came in an earlier block."""
    seen, out = set(), []
    for k, (role, text) in enumerate(zip(roles, texts)):
        said = text.rstrip(BLANKS)
        if not said:
            out.append("blank")
        elif k in known or (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if said[-1] in STOPS else "truncated")
        seen.add((role, text))
    return out


def summary(turns: list, roles: list[str], found: list[str]) -> dict:
    """Counts that blocks of a conversation can add up; ``low``, ``high`` and the ends join them."""
    known = [t for t in turns if t is not None]
    legal = ("su", "ua", "au")
    counts = {f: found.count(f) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a[:1] + b[:1] not in legal for a, b in zip(roles, roles[1:]))
    return counts | {"illegal": illegal, "distinct": len(set(known)), "low": known[0] if known else None, "high": known[-1] if known else None, "first": roles[0][:1], "last": roles[-1][:1]}


def joined(a: dict, b: dict) -> dict:
    """The summary of two adjacent pieces."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    low, high = (a["low"], b["high"]) if a["low"] is not None and b["high"] is not None else (a["low"], a["high"]) if b["low"] is None else (b["low"], b["high"])
    return out | {"low": low, "high": high, "first": a["first"], "last": b["last"]}


def _gaps(s: dict) -> int:
    return 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]


def lines(audit: str, edited: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as role:text."""
    out, k = [], 0
    for edit, x in zip(audit, edited):
        if edit == "I":
            out.append(f"{ROLES[x]}:")
            continue
        if edit != "D":
            out.append(f"{roles[k] if edit == 'K' else ROLES[x]}:{texts[k]}")
        k += 1
    return out


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
_LONG, _TEXT = pa.int64(), pa.string()
_DONE = [(n, _TEXT if n in ("audit", "repaired_sha256") else _LONG) for n in _NAMES]
_BLOCK = [("blk", _LONG), ("turns", pa.list_(_LONG)), ("roles", pa.list_(_TEXT)), ("texts", pa.list_(_TEXT))]


def _key(column: str) -> F.Column:
    """A join key of conv_id that is never null."""
    return F.when(F.col(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def _result(s: dict, cost: int, audit: str, digest: str) -> dict:
    return {"gaps": _gaps(s), **{k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _frames(rows, schema: pa.Schema, most: int = 256):
    """Record batches of some hundred rows."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _passed(rows: DataFrame) -> DataFrame:
    """(conv, RESULT) of conversations inside a task; blocks (conv, blk, turns, roles, texts) of the others."""
    schema = pa.schema([("conv", _TEXT), *_DONE, *_BLOCK])

    def whole(g, conv, turns, roles, texts):
        found = faults(roles, texts)
        cost, audit, edited, _ = cheapest(g, parse(g, [(r[:1], f) for r, f in zip(roles, found)]))
        digest = hashlib.sha256("\n".join(lines(audit, edited, roles, texts)).encode()).hexdigest()
        return {"conv": conv} | _result(summary(turns, roles, found), cost, audit, digest)

    def results(batches):
        g, base = Grammar(), TaskContext.get().partitionId() << 32
        held: tuple = ([], [], [])
        conv, size, blk, cut = None, 0, 0, True  # cut: what came before may be in another block

        def block():
            nonlocal blk
            blk += 1
            return {"conv": conv, "blk": base + blk, "turns": held[0], "roles": held[1], "texts": held[2]}

        for b in batches:
            for key, *row in zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "role", "text")]):
                if key != conv:
                    if conv is not None:
                        yield block() if cut else whole(g, conv, *held)
                        cut = False
                    conv, size, held = key, 0, ([], [], [])
                elif len(held[0]) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield block()
                    cut, size, held = True, 0, ([], [], [])
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[2]) * 4
        if held[0]:
            yield block()

    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "nth")]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("nth")
    return dealt.mapInArrow(lambda batches: _frames(results(batches), schema), f"conv string, {RESULT}, blk long, turns array<bigint>, roles array<string>, texts array<string>")


def _repeated(blocks: DataFrame) -> DataFrame:
    """(conv, blk, known): positions in a block whose role and text came earlier in the conversation."""
    each = blocks.select("conv", "blk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    digest = F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")), 256)
    each = each.select("conv", digest.alias("digest"), F.struct("blk", "at").alias("place"))
    first = each.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(first, ["conv", "digest"]).filter("place > first")
    return later.groupBy("conv", "place.blk").agg(F.collect_list("place.at").alias("known"))


def _transfers(blocks: DataFrame) -> DataFrame:
    """(conv, blk, n, summary, paths) with the least path from each top to each top, as JSON."""
    schema = pa.schema([("conv", _TEXT), ("blk", _LONG), ("n", _LONG), ("summary", _TEXT), ("paths", _TEXT)])

    def results(batches):
        g = Grammar()
        for b in batches:
            for conv, blk, turns, roles, texts, known in zip(*[b.column(c).to_pylist() for c in ("conv", "blk", "turns", "roles", "texts", "known")]):
                found = faults(roles, texts, set(known or ()))
                rows = [(r[:1], f) for r, f in zip(roles, found)]
                paths = {top: [p[:3] + (p[3][-1],) for p in parse(g, rows, stack).values()] for top, stack in g.tops().items()}
                yield {"conv": conv, "blk": blk, "n": len(rows), "summary": json.dumps(summary(turns, roles, found)), "paths": json.dumps(paths)}

    return blocks.mapInArrow(lambda batches: _frames(results(batches), schema, 16), "conv string, blk long, n long, summary string, paths string")


def _chained(transfers: DataFrame) -> DataFrame:
    """(conv, RESULT without its digest, slices of blk, audit, edited), conversation by conversation as the rows stream by."""
    slices = pa.list_(pa.struct([("blk", _LONG), ("audit", _TEXT), ("edited", _TEXT)]))
    schema = pa.schema([("conv", _TEXT), *_DONE, ("slices", slices)])

    def finish(g, tops, conv, total, front, settled, blocks):
        cost, audit, edited, _ = min(p for p in front.values() if g.accepts(tops[p[3]]))
        audit, edited = ("".join(x) for x in zip(*settled, (audit, edited)))
        out, at = [], 0
        for k, (blk, n) in enumerate(blocks):
            end = at
            while n:  # so many edits of rows; insertions after the last one are the next block's
                n -= audit[end] != "I"
                end += 1
            end = len(audit) if k + 1 == len(blocks) else end
            out.append({"blk": blk, "audit": audit[at:end], "edited": edited[at:end]})
            at = end
        return {"conv": conv} | _result(total, cost, audit, "") | {"slices": out}

    def results(batches):
        g = Grammar()
        tops = g.tops()
        conv = None
        for b in batches:
            for key, blk, n, said, paths in zip(*[b.column(c).to_pylist() for c in ("conv", "blk", "n", "summary", "paths")]):
                own, paths = json.loads(said), json.loads(paths)
                if key != conv:
                    if conv is not None:
                        yield finish(g, tops, conv, total, front, settled, blocks)  # noqa: F821
                    conv, total, front, settled, blocks = key, None, {0: (0, "", "", 0)}, [], []
                new: dict = {}
                for top, (cost, audit, edited, _) in front.items():
                    for more, a, e, to in paths[str(top)]:
                        path = (cost + more, audit + a, edited + e, to)
                        if to not in new or path < new[to]:
                            new[to] = path
                same = len(os.path.commonprefix([p[1] for p in new.values()]))
                same = min(same, len(os.path.commonprefix([p[2] for p in new.values()])))
                some = next(iter(new.values()))
                settled.append((some[1][:same], some[2][:same]))
                front = {t: (c, a[same:], e[same:], to) for t, (c, a, e, to) in new.items()}
                total = own if total is None else joined(total, own)
                blocks.append((blk, n))
        if conv is not None:
            yield finish(g, tops, conv, total, front, settled, blocks)

    dealt = transfers.repartition("conv").sortWithinPartitions("conv", "blk")
    return dealt.mapInArrow(lambda batches: _frames(results(batches), schema, 16), f"conv string, {RESULT}, slices array<struct<blk:bigint,audit:string,edited:string>>")


def _digests(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) over the blocks' repaired rows in order."""

    def write(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("audit", "edited", "roles", "texts")]
            piece = ["\n".join(lines(*row)).encode() for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("blk"), pa.array(piece, pa.binary())], names=["conv", "blk", "piece"])

    def digest(batches):
        conv = None
        for b in batches:
            for key, piece in zip(b.column("conv").to_pylist(), b.column("piece").to_pylist()):
                if key != conv:
                    if conv is not None:
                        yield {"conv": conv, "repaired_sha256": sha.hexdigest()}  # noqa: F821
                    conv, sha, begun = key, hashlib.sha256(), False
                if piece:
                    sha.update(b"\n" * begun + piece)
                    begun = True
        if conv is not None:
            yield {"conv": conv, "repaired_sha256": sha.hexdigest()}

    schema = pa.schema([("conv", _TEXT), ("repaired_sha256", _TEXT)])
    pieces = blocks.join(slices, ["conv", "blk"]).mapInArrow(write, "conv string, blk long, piece binary")
    return pieces.repartition("conv").sortWithinPartitions("conv", "blk").mapInArrow(lambda batches: _frames(digest(batches), schema), "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv, RESULT) for each conversation of ``rows`` (conv_id, turn, role, text); ``conv`` is ``_key`` of conv_id."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    passed = stored(_passed(rows.select(_key("conv_id").alias("conv"), "turn", space("role"), space("text"))), "passed")
    done, blocks = passed.filter("blk IS NULL").select("conv", *_NAMES), passed.filter("blk IS NOT NULL").select("conv", "blk", "turns", "roles", "texts")
    transfers = _transfers(blocks.join(_repeated(blocks), ["conv", "blk"], "left"))
    chained = stored(_chained(transfers), "chained")
    slices = chained.select("conv", F.explode("slices").alias("s")).select("conv", "s.*")
    long = chained.drop("repaired_sha256", "slices").join(_digests(blocks, slices), "conv")
    return done.unionByName(long.select("conv", *_NAMES))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults of the contract, by crc32 of conv_id:turn."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn")).cast("binary")) % 20
    r = rows.select("conv_id", "turn", show("role").alias("role"), show("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("nth")).drop("nth")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", _key("conv_id").alias("conv"))
    found = every.join(repair(damaged(rows)), "conv", "left").drop("conv")
    empty = {n: 0 for n in _NAMES[:6]} | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return found.fillna(empty)


#: Row after row for all conversations at once: least (cost, audit) at the start, after s, after u and after a.
_D = lambda f: f"{{'c': {f}.c + {DELETE}, 'a': {f}.a || 'D'}}"
_I = lambda f: f"{{'c': {f}.c + {INSERT}, 'a': {f}.a || 'I'}}"
_TO = lambda f, x: f"{{'c': {f}.c + w + CASE WHEN i = '{x}' THEN 0 ELSE {REROLE} END, 'a': {f}.a || CASE WHEN i = '{x}' THEN 'K' ELSE 'R' END}}"
SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(k, '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM src, crc_table),
bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, LATERAL (SELECT unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))) WHERE kind <> 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM bad),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again,
    left(role, 1) AS i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM placed),
f AS MATERIALIZED (
  SELECT *, CASE WHEN ending = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM seen),
best AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS p0, {{'c': 1000000::BIGINT, 'a': ''}} AS ps, {{'c': {INSERT}::BIGINT, 'a': 'I'}} AS pu, {{'c': {2 * INSERT}::BIGINT, 'a': 'II'}} AS pa
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, p0, ps, u AS pu, list_min([a, {_I("u")}]) AS pa FROM (
    SELECT *, list_min([u0, {_I("p0")}, {_I("ps")}, {_I("a")}]) AS u FROM (
      SELECT b.conv_id, f.n, {_D("b.p0")} AS p0,
        CASE WHEN ok AND i = 's' THEN list_min([{_D("b.ps")}, {{'c': b.p0.c + w, 'a': b.p0.a || 'K'}}]) ELSE {_D("b.ps")} END AS ps,
        CASE WHEN ok THEN list_min([{_D("b.pu")}, {_TO("b.p0", "u")}, {_TO("b.ps", "u")}, {_TO("b.pa", "u")}]) ELSE {_D("b.pu")} END AS u0,
        CASE WHEN ok THEN list_min([{_D("b.pa")}, {_TO("b.pu", "a")}]) ELSE {_D("b.pa")} END AS a
      FROM best b JOIN (SELECT conv_id, n, i, fault IN ('t', 'k') AS ok, CASE WHEN fault = 't' THEN {TRUNCATED} ELSE 0 END AS w FROM f) f
        ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = b.n + 1))),
least AS MATERIALIZED (SELECT conv_id, list_min([p0, pa]) AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS r FROM best) WHERE r = 1),
edits AS (
  SELECT conv_id, j, x, (count(*) FILTER (x <> 'I') OVER w)::BIGINT AS n, (count(*) FILTER (x <> 'D') OVER w)::BIGINT AS m
  FROM (SELECT conv_id, unnest(range(1, len(p.a) + 1)) AS j, unnest(string_split(p.a, '')) AS x FROM least WHERE p.a <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
said AS (
  SELECT e.conv_id, e.j, x, m, f.role, f.text, max(CASE WHEN x = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS s
  FROM edits e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n AND x <> 'I'),
fixed AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t
  FROM said WHERE x <> 'D' GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, p.c AS cost, p.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM least l LEFT JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed x ON l.conv_id IS NOT DISTINCT FROM x.conv_id
"""
