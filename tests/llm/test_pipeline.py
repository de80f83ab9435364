"""The pipeline's stages, each on what the one before kept."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from popspark.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert all(before[i] == t for i, t in after.items())
        if name == "language_id":
            gone = set(before) - set(after)
            assert all(not re.search(r"[^\W\d_]", before[i] or "") for i in gone)
        if name == "exact_dedup":
            squash = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
            first = {}
            for i in sorted(before):
                first.setdefault(squash(before[i]), i)
            assert set(after) == set(first.values())
        docs = out
    final = P.STAGES[-1][1](spark, docs, SF)
    assert final.count() == docs.count() and "doc_id" in final.columns


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    key = lambda r: (r["doc_id"], r["source"] or "", r["n_tokens"], r["decoded_sha256"])
    want = sorted(map(key, docs.collect()))
    assert want and sorted(map(key, P.run(spark, SF).collect())) == want


def test_near_and_mixing_stages_against_brute_force(spark):
    """Of each component of near copies the least doc_id stays; the mix takes whole rows up to twice, near its targets."""
    base = [f"w{i}" for i in range(80)]
    rows = [(10 - k, " ".join(base[:80 - k]), "s%d" % (k % 2)) for k in range(6)] + [(100 + k, f"only {k} " * (k + 6), None if k % 3 == 0 else "s1") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = P.near(spark, docs, SF)
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t, _ in rows}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {r["doc_id"] for r in near.collect()} == set(sets) - gone and len(gone) >= 5
    mixed = P.mixed(spark, docs, SF).collect()
    times = {i: sum(r["doc_id"] == i for r in mixed) for i in sets}
    assert max(times.values()) <= 2 and all(r in set(map(tuple, docs.collect())) for r in map(tuple, mixed))
    size = {i: len(t.split()) for i, t, _ in rows}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in (None, "s0", "s1")}
    # weights 3, 1, 2 in the order s0, s1, null: s0 stops at twice its size
    left = 1.5 * sum(total.values()) - 2 * total["s0"]
    target = {"s0": 2 * total["s0"], "s1": min(2 * total["s1"], left / 3), None: min(2 * total[None], left * 2 / 3)}
    if left * 2 / 3 > 2 * total[None]:
        target["s1"] = min(2 * total["s1"], left - 2 * total[None])
    for s, want in target.items():
        taken = sum(size[i] * times[i] for i, _, x in rows if x == s)
        assert abs(taken - want) <= max(size[i] for i, _, x in rows if x == s)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows and columns with the names that operators use."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, "b", 3), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, "one  two", "de", "b", 8), (6, long, "en", "a", 1),
        (7, long + " tail", "en", "c", 1), (8, "12 34 !!", None, None, 8), (None, "one two three four five six", None, "a", 1), (None, "one two three four five six", None, "a", 1), (9, "one two three four five six", "en", None, 1),
    ]
    names = ["score", "lang_pred", "lang_told", "row", "__kept", "__nth", "__size", "__id", "__dup", "__copies", "__copy", "digest", "size", "component_id", "own", "least", "last", "dup"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in names})
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and all(r[c] == "mine" for r in out.select(*names).collect() for c in names)
        assert stage(spark, docs.limit(0), SF).count() == 0
        ids = sorted(r["doc_id"] or 0 for r in out.collect())
        assert ids == {"language_id": [0, 0, 4, 4, 5, 6, 7, 9], "exact_dedup": [4, 6, 7, 9], "ngram_join": [4, 6, 9]}.get(name, ids)
        docs = out
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count() and P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
