"""Near-duplicate components by an exact Jaccard join on word shingles, as a grouped prefix join.

Texts with one word sequence are a class with one representative.  Each representative's shingles are ordered by
document frequency, counted over all representatives, then by hash; two sets with Jaccard similarity of at least
t share a shingle among the first n - ceil(t n) + 1 of each.  Shingles that no other document has are left out, so
most documents leave here.  Documents with one prefix and size form a group with one head.

Links only matter for components, so pairs inside a large bucket are not all made:

1. star: in each bucket of a prefix shingle every group head meets the bucket's least peculiar head, and every
   member its own head; pairs are verified on the texts and linked into components;
2. stars of documents, around the least peculiar one and then around others, in buckets that still hold more than
   one component;
3. whatever pairs of groups with different components in one bucket are left are filtered, expanded to their
   members and verified.

Throughout, pairs whose places in the order leave too few shingles to be common are no candidates.  In step 3 members
also need parity sketches close enough for the similarity asked for, which is exact too: a shingle that only one of
two sets holds flips one bit, so sketches differ in no more bits than the sets in shingles.  After this no link between two
components can have been missed.

Defined results: null text and texts without words have no shingles and link with nothing; fewer words than a
shingle count as one shingle; exact copies share a class; rows with a repeated doc_id each get a row and a component by
their own text; a null doc_id is never the least of a component unless all are null, and then the component is null;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popspark.llm.common import Words, byte_slices, documents, parts_for, signed, stored, text_bytes, unused
from popspark.llm.components import components
from popspark.llm.exchange import buckets_for, exchange, units_for

WORDS = 5
PERCENT = 80
#: Star rounds of documents before what remains is paired; only how work is spread depends on it.
ROUNDS = 2
#: 64-bit parts of a sketch.
SKETCH = 8

CLASS = "doc_id long, deal long, h1 long, h2 long, n_words long"


def _dealt(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.lit(41), "doc_id", "text").alias("deal"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id with a 128-bit hash of its lower-cased word sequence; ``deal`` is the hash that units are dealt by."""

    def run(batches):
        for b in byte_slices(batches, "text", 1_000_000):
            w = Words(b.column("text"), lower=True)
            columns = [b.column("doc_id"), b.column("deal"), *(pa.array(signed(w.whole(k))) for k in (0, 1)), pa.array(w.count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "deal", "h1", "h2", "n_words"])

    return _dealt(docs).mapInArrow(run, CLASS)


class Shingles:
    """Distinct shingle hashes of the documents at ``rows`` of a column of texts, sorted by document and hash."""

    def __init__(self, words: Words, hashes: np.ndarray, rows: np.ndarray, size: int):
        chosen = np.zeros(len(words.count), bool)
        chosen[rows] = True
        total = len(words.start)
        room = words.first[1:][words.doc] - np.arange(total) if total else np.zeros(0, np.int64)
        at = np.flatnonzero(chosen[words.doc] & ((room >= size) | ((words.count[words.doc] < size) & (room == words.count[words.doc]))))
        # a short text's window must not run into the next text
        end = np.minimum(at + size, words.first[1:][words.doc[at]])
        value, doc = words.spans(hashes, at, end), words.doc[at]
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(at) else np.zeros(0, bool)
        self.value, self.doc = value[new], doc[new]
        self.count = np.bincount(self.doc, minlength=len(words.count))
        self.first = np.append(0, np.cumsum(self.count))


def sketches(s: Shingles, docs: int) -> np.ndarray:
    """(document x SKETCH) parity sketches: each shingle flips one bit."""
    bits = 64 * SKETCH
    at = s.doc * bits + ((s.value >> np.uint64(11)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(at, minlength=docs * bits).astype(np.uint8) & 1
    return np.packbits(flips.reshape(docs, bits), axis=1).view(np.int64)


REP = "id long, n long, uniq long, typical long, t1 long, t2 long, tokens array<long>, sketch array<long>, words string"
_LONGS = pa.list_(pa.int64())
_REP = pa.schema([*((c, pa.int64()) for c in ("id", "n", "uniq", "typical", "t1", "t2")), ("tokens", _LONGS), ("sketch", _LONGS), ("words", pa.string())])


def _representatives(docs: DataFrame, reps: DataFrame, n_bytes: int, size: int, percent: int) -> DataFrame:
    """REP for each of ``reps`` (id, deal, h1, h2); all but id and n only where a prefix shingle is in other documents too.

    ``typical`` is the sum of the document frequencies of all shingles.
    """
    unit = F.pmod("deal", F.lit(units_for(n_bytes))).alias("unit")
    none = [F.lit(None).cast("long").alias(c) for c in ("id", "h1", "h2")]
    rows = _dealt(docs).select(unit, F.coalesce("text", F.lit("")).alias("text"), *none)
    marks = reps.select(unit, F.lit(None).cast("string").alias("text"), "id", "h1", "h2")

    def unpack(table):
        marked = pc.is_null(table.column("text"))
        want = table.filter(marked)
        want = dict(zip(zip(want.column("h1").to_pylist(), want.column("h2").to_pylist()), want.column("id").to_pylist()))
        own = table.filter(pc.invert(marked)).sort_by([("text", "ascending")])
        w = Words(own.column("text"), lower=True)
        h = w.hashes()
        rows, ids = [], []
        # the second half of a hash is needed only where the first one is wanted
        one = signed(w.whole())
        at = np.flatnonzero(np.isin(one, np.array([a for a, _ in want], np.int64)))
        two = signed(Words(own.column("text").take(pa.array(at)), lower=True).whole(1))
        for i, key in zip(at.tolist(), zip(one[at].tolist(), two.tolist())):
            if key in want:
                rows.append(i)
                ids.append(want.pop(key))
        return ids, w, Shingles(w, h, np.array(rows, np.int64), size), rows

    def items(table):
        _, _, s, _ = unpack(table)
        return np.unique(s.value >> np.uint64(32), return_counts=True)

    def answer(table, keys, totals):
        ids, w, s, rows = unpack(table)
        df = totals[np.searchsorted(keys, s.value >> np.uint64(32))] if len(s.value) else np.zeros(0, np.int64)
        order = np.lexsort((s.value, df, s.doc))
        value, df = s.value[order], df[order]
        docs = len(w.count)
        uniq = np.bincount(s.doc, weights=df == 1, minlength=docs).astype(np.int64)
        typical = np.bincount(s.doc, weights=df, minlength=docs).astype(np.int64)
        sketch = sketches(s, docs)
        out = {c: [] for c in _REP.names}
        for i, key in zip(rows, ids):
            n, at = int(s.count[i]), int(s.first[i])
            prefix = slice(at, at + n - -(-percent * n // 100) + 1)
            tokens = value[prefix][df[prefix] > 1]
            row = [key, n, *[None] * 7]
            if len(tokens):
                mark = [int(x) for x in signed(np.array([np.bitwise_xor.reduce(tokens * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)], np.uint64))]
                spans = zip(w.start[w.first[i] : w.first[i + 1]].tolist(), w.end[w.first[i] : w.first[i + 1]].tolist())
                data = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                text = b" ".join([data[a - w.offsets[i] : b - w.offsets[i]] for a, b in spans]).decode()
                row = [key, n, int(uniq[i]), int(typical[i]), *mark, signed(tokens), sketch[i], text]
            for c, v in zip(_REP.names, row):
                out[c].append(v)
        return pa.Table.from_pydict(out, schema=_REP)

    return exchange(rows.unionByName(marks), buckets_for(n_bytes), items, answer, REP, key_type=np.uint32)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets reach the similarity; ``texts`` has id and words."""
    left = texts.select(F.col("id").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("words").alias("y"))
    rows = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for whole in batches:
            for b in byte_slices([whole], "x", 1_000_000):
                n = b.num_rows
                w = Words(pa.concat_arrays([b.column("x").cast(pa.large_string()), b.column("y").cast(pa.large_string())]))
                s = Shingles(w, w.hashes(), np.arange(2 * n), size)
                pair = s.doc % n
                order = np.lexsort((s.value, pair))
                v, p = s.value[order], pair[order]
                both = np.bincount(p[1:][(v[1:] == v[:-1]) & (p[1:] == p[:-1])], minlength=n) if len(v) else np.zeros(n, np.int64)
                union = s.count[:n] + s.count[n:] - both
                ok = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _may_link(n1: str, at1: str, n2: str, at2: str, percent: int) -> F.Column:
    """Whether texts of n1 and n2 shingles whose first common one is at places at1 and at2 of their orders can link.

    No more than what follows can be common, and (100 + p) * common >= p * (n1 + n2) is the similarity asked for.
    Later common shingles give a lower bound, so a pair that can link passes at its first one.
    """
    most = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col(n1) + F.col(n2))


def _sketches_allow(n1: str, s1: str, n2: str, s2: str, percent: int) -> F.Column:
    """Whether two sets can be as similar as asked for: no more than (100 - p) / (100 + p) of n1 + n2 in only one of them."""
    apart = reduce(add, [F.bit_count(F.get(s1, F.lit(k)).bitwiseXOR(F.get(s2, F.lit(k)))) for k in range(SKETCH)])
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col(n1) + F.col(n2))


GROUP = ["n", "t1", "t2"]


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    members = stored(classes(docs), "classes")
    firsts = members.filter("n_words > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.min("deal").alias("deal"))
    # numbers are settled once they are written
    firsts = stored(firsts.withColumn("id", F.monotonically_increasing_id()), "firsts")
    reps = stored(_representatives(docs, firsts.select("id", "deal", "h1", "h2"), text_bytes(docs), size, percent), "representatives")
    texts = reps.filter("words IS NOT NULL")
    parts = parts_for(texts.agg(F.sum(F.size("tokens"))).first()[0] or 0)

    # groups of one prefix and size; the head is the least peculiar: fewest shingles of its own, then the most typical
    least = F.struct("uniq", (-F.col("typical")).alias("odd"), "id")
    groups = texts.groupBy(*GROUP).agg(F.min(least).alias("h"), F.first("tokens").alias("tokens"))
    groups = groups.select(F.monotonically_increasing_id().alias("group"), *GROUP, "h.uniq", "h.odd", F.col("h.id").alias("head"), "tokens")
    groups = stored(groups, "groups", parts)
    grouped = texts.select("id", "typical", "sketch", *GROUP).join(groups.select(*GROUP, "group", "uniq", "head").hint("merge"), GROUP)
    grouped = stored(grouped.select("id", "group", "head", "n", "uniq", (-F.col("typical")).alias("odd"), "sketch"), "grouped", parts)
    # shingles of no other text come first in the order, so the k-th shared one is at place uniq + k
    tokens = groups.select(F.posexplode("tokens").alias("k", "token"), "group", "n", "uniq", "odd", F.col("head").alias("id"))
    tokens = stored(tokens.withColumn("at", F.col("uniq") + F.col("k")).drop("k"), "tokens", parts)

    inside = grouped.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    tried = stored(_ordered(_stars(tokens, ["uniq", "odd", "id"], percent, parts).unionByName(inside)), "pairs", parts)
    links = stored(verified(tried, texts, size, percent), "links", parts)
    labels = stored(components(links), "labels", parts)
    for k in range(ROUNDS + 1):
        labelled = grouped.join(labels.hint("merge"), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        labelled = stored(labelled, "labelled", parts)
        mixed = _mixed(tokens.drop("id", "odd"), labelled, parts)
        if k < ROUNDS:
            rows = mixed.select("token", "group", "at").join(labelled.drop("sketch").hint("merge"), "group")
            order = ["uniq", "odd", "id"] if k == 0 else [f"xxhash64(id, {k})"]
            pairs = _stars(stored(rows, "entries", parts), order, percent, parts)
        else:
            pairs = _remaining(mixed, labelled, percent, parts)
        fresh = stored(_ordered(pairs).join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs", parts)
        found = stored(verified(fresh, texts, size, percent), "links", parts)
        tried = tried.unionByName(fresh)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = stored(components(links), "labels", parts)

    linked = labels.join(firsts.select("id", "first").hint("merge"), "id")
    least = linked.groupBy("component_id").agg(F.min("first").alias("least"))
    linked = stored(linked.join(least.hint("merge"), "component_id").select("id", "least"), "linked", parts)
    reached = firsts.join(reps.select("id", "n").hint("merge"), "id").join(linked.hint("merge"), "id", "left")
    reached = stored(reached.select("h1", "h2", "n", F.coalesce("least", "first").alias("component_id")), "reached")
    # texts without words share one hash: they stay apart
    out = members.withColumn("h1", F.when(F.col("n_words") > 0, F.col("h1")))
    out = out.join(reached.hint("merge"), ["h1", "h2"], "left")
    own = F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), own.alias("component_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _stars(entries: DataFrame, order: list[str], percent: int, tasks: int) -> DataFrame:
    """(a, b): each document of a bucket with the bucket's least by the expressions ``order``, where they can link and components differ."""
    own = [c for c in ("id", "n", "at", "component_id") if c in entries.columns]
    least = F.struct(*[F.expr(x).alias(f"by{k}") for k, x in enumerate(order)], *own)
    centre = entries.groupBy("token").agg(F.min(least).alias("p"), F.count("*").alias("m")).filter("m > 1").select("token", "p")
    rows = entries.join(stored(centre, "pivots", tasks).hint("merge"), "token")
    apart = F.col("component_id") != F.col("p.component_id") if "component_id" in entries.columns else F.lit(True)
    return rows.filter((F.col("id") != F.col("p.id")) & _may_link("n", "at", "p.n", "p.at", percent) & apart).select(F.col("p.id").alias("a"), F.col("id").alias("b"))


def _mixed(tokens: DataFrame, labelled: DataFrame, tasks: int) -> DataFrame:
    """``tokens`` of the buckets that hold more than one component, with the least and greatest component of each group."""
    parts = stored(labelled.groupBy("group").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")), "parts", tasks)
    rows = stored(tokens.join(parts.hint("merge"), "group"), "tokens", tasks)
    bad = stored(rows.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("token"), "mixed", tasks)
    return stored(rows.join(bad.hint("merge"), "token", "left_semi"), "mixed", tasks)


def _remaining(mixed: DataFrame, labelled: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b): every pair of documents that share a bucket, are of different components and pass all filters."""
    one, two = (mixed.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("group", "n", "at", "lo", "hi")]) for i in (1, 2))
    apart = (F.least("lo1", "lo2") < F.greatest("hi1", "hi2")) & _may_link("n1", "at1", "n2", "at2", percent)
    pairs = one.join(two.hint("merge"), (one["token"] == two["token"]) & (F.col("group1") <= F.col("group2")) & apart)
    pairs = stored(pairs.select("group1", "group2").distinct(), "groups", tasks)
    one, two = (labelled.select(*[F.col(c).alias(f"{c}{i}") for c in ("group", "id", "n", "component_id", "sketch")]) for i in (1, 2))
    rows = pairs.join(one.hint("merge"), "group1")
    allowed = (F.col("component_id1") != F.col("component_id2")) & _sketches_allow("n1", "sketch1", "n2", "sketch2", percent)
    rows = rows.join(two.hint("merge"), (rows["group2"] == two["group2"]) & allowed)
    return rows.select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def keep_first(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row with the least doc_id, null last; rows without words all stay."""
    row = unused(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    # the row's number takes the place of its doc_id, so that it alone can stay
    found = stored(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), size, percent), "components")
    ids = rows.select(F.col(row).alias("own"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"))
    linked = found.join(ids.hint("merge"), found["doc_id"] == ids["own"]).groupBy("component_id")
    stays = stored(linked.agg(F.min(F.struct("last", ids["doc_id"], "own")).alias("least")).select(F.col("least.own").alias(row)), "stays")
    return rows.join(stays.hint("merge"), row, "left_semi").drop(row)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 80 * (m.n + n.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""
