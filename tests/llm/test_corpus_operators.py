"""The corpus operators against brute force, public libraries and awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

from popspark.llm import bpe, ctw, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, quality, substring_dedup, token_counts
from popspark.llm.catalog import ORACLES, QUERIES
from popspark.llm.common import Words, stored
from popspark.llm.components import components

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def awkward(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, "b", 3), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, "one  two", "de", "b", 8),
        (6, long, "en", "a", 1), (7, long + " tail", "en", "c", 1), (8, "12 34 !!", None, None, 8), (9, "é ß Σ İ <|endoftext|> x", "fr", "c", 9), (None, "one two three four five six", None, "a", 1), (10, "zz " * 50, "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"unit": F.lit(1), "size": F.lit("x"), "score": F.lit(2), "component_id": F.lit(0), "digest": F.lit("d"), "copies": F.lit(9), "label": F.lit(1)})


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def table(df):
    return df.toPandas()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in docs(spark).select("doc_id", "text").collect()}


# -- oracles and rows ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


# -- BPE ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = np.random.default_rng(1)
    letters = list("aAbBtheinginé'sΣσİß \t\n\x1c\x85 　éé中文字12½²!?…ñÑǅ'll'VE\U0001f600") + ["<|endoftext|>"]
    cases = list(texts.values()) + ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)] + ["x" * 3000, "ab" * 500, "", "<|endoftext|", "'s't"]
    for text, got, want in zip(cases, own.encode(cases), lib.encode_batch(cases, add_special_tokens=False)):
        assert [int(i) for e in got for i in e[0].split()] == want.ids, repr(text[:80])
        assert " ".join(e[2] for e in got) == lib.decode(want.ids, skip_special_tokens=False)


def test_bpe_classes_every_character_as_the_library_does():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    recent = bpe.regex.findall(own.recent.any, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    cases = [f"a{c}B" for c in [*recent, *map(chr, range(0x3000)), *map(chr, range(0xA000, 0xD800, 7)), *map(chr, range(0xE000, 0x20000, 5))]]
    for text, got, want in zip(cases, own.encode(cases), lib.encode_batch(cases, add_special_tokens=False)):
        assert [int(i) for e in got for i in e[0].split()] == want.ids, ascii(text)


def test_bpe_pair_test_agrees_with_merging():
    own = bpe.WordBpe(bpe.tokenizer_path())
    rng = np.random.default_rng(2)
    cases = ["".join(rng.choice(list("aeinstrhlo"), rng.integers(1, 14))) for _ in range(4000)]
    assert own.encode_words(cases) == [own.exact(w) for w in cases]
    long = "thequickbrown" * 9
    assert own.exact(long) == own.exact_long([own.vocab[x] for x in own.spell(long)])


def test_bpe_round_trip_and_awkward_rows(spark):
    d = awkward(spark)
    e = bpe.encode(d)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(e).collect()}
    assert back[1] == back[2] == back[3] == "" and back[4] == "one</w> two</w>"
    assert bpe.digests(d).count() == d.count() and bpe.encode_documents(d).count() == d.count()
    assert bpe.digests(d.limit(0)).count() == 0


# -- exact dedup ------------------------------------------------------------------------------------------------------


def test_exact_dedup_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, path=stored_path(spark), buckets=4)
    one = spark.createDataFrame([(5, "a  b"), (9, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string")
    first = {r["doc_id"]: r["keep_id"] for r in exact_dedup.deduplicate(one, index).collect()}
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(two, index).collect()}
    assert first == {5: 5, 9: 9} and second == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert index.table().count() == 3
    # opened by path under another name, as a session that does not know the table would
    again = exact_dedup.DigestIndex(spark, path=index.path, buckets=16)
    assert again.buckets == 4 and again.name != index.name
    three = spark.createDataFrame([(0, "c"), (7, "e"), (7, "e")], "doc_id long, text string")
    third = sorted(map(tuple, exact_dedup.deduplicate(three, again).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert third == [(0, 9, 1, False), (7, 7, 2, False), (7, 7, 2, True)]
    assert again.table().count() == 4 and {r["keep_id"] for r in again.table().collect()} == {5, 9, 2, 7}


def stored_path(spark):
    from popspark.llm.common import scratch_path

    return scratch_path(spark, "index")


def test_exact_dedup_plans_an_anti_join(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = exact_dedup.digests(docs(spark)).groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
    plan = index.unknown(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    first, both = (table(exact_dedup.deduplicate(docs(spark), exact_dedup.DigestIndex(spark), batches=n)).sort_values("doc_id") for n in (1, 3))
    assert first.reset_index(drop=True).equals(both.reset_index(drop=True))


def test_exact_dedup_keeps_one_row(spark):
    rows = [(4, "x", "a"), (4, "x", "b"), (4, "x", "b"), (5, " x", "c"), (None, "n", "d"), (None, "n", "e"), (9, "n", "f"), (None, "m", "g"), (None, "m", "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for batches in (1, 2):
        got = table(exact_dedup.deduplicate(d, exact_dedup.DigestIndex(spark), batches))
        assert len(got) == 9 and got.kept.sum() == 4 and set(got[got.kept].doc_id.dropna()) == {4, 5, 9}
        kept = exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark), batches)
        assert kept.columns == d.columns and sorted(r["text"] for r in kept.collect()) == [" x", "m", "n", "x"]


def test_exact_dedup_awkward_rows(spark):
    d = awkward(spark)
    got = table(exact_dedup.deduplicate(d, exact_dedup.DigestIndex(spark)))
    assert len(got) == d.count()
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[1].keep_id == by[2].keep_id == 1 and by[5].keep_id == 4 and by[5].group_size == 3
    kept = exact_dedup.keep_first(d, exact_dedup.DigestIndex(spark))
    assert kept.columns == d.columns and kept.filter("doc_id = 5 OR doc_id = 2").count() == 0
    assert exact_dedup.deduplicate(d.limit(0), exact_dedup.DigestIndex(spark)).count() == 0


# -- substring dedup ------------------------------------------------------------------------------------------------


def removed(texts, size=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        cover = [False] * len(w)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            if k in seen:
                cover[p : p + size] = [True] * size
            seen.add(k)
        kept = " ".join(x for x, c in zip(w, cover) if not c)
        out[i] = (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark, texts):
    got = {r[0]: tuple(r)[1:4] for r in substring_dedup.remove_repeats(docs(spark)).collect()}
    assert got == removed(texts)


def test_substring_dedup_of_repeated_ids(spark):
    """Rows that share a doc_id or have none go by a hash of their texts, however they are dealt."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"{head} {passage} tail{k}") for k, (i, head) in enumerate([(3, "a"), (3, "b"), (3, "c"), (None, "d"), (None, "e"), (8, "f")])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64(F.lit(5), "text"))
    order = sorted(d.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["tie"]))
    want = sorted((r["doc_id"] or -1, 0 if k == 0 else 25) for k, r in enumerate(order))
    for n in (1, 3):
        got = substring_dedup.remove_repeats(d.drop("tie").repartition(n))
        assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got.collect()) == want


def test_substring_dedup_awkward_rows(spark):
    d = awkward(spark)
    got = table(substring_dedup.remove_repeats(d))
    assert len(got) == d.count() and got.set_index("doc_id").n_words[1.0] == 0
    distinct = d.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = removed({r["doc_id"]: r["text"] for r in distinct.collect()})
    assert {r[0]: tuple(r)[1:4] for r in substring_dedup.remove_repeats(distinct).collect()} == want
    assert want[7][1] == 30_000 and want[10][1] > 0
    assert substring_dedup.remove_repeats(d.limit(0)).count() == 0


# -- n-gram join ----------------------------------------------------------------------------------------------------


def linked(texts):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    common, holders = collections.Counter(), collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in holders[s])
            holders[s].append(i)
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in ngram_join.near_duplicates(docs(spark)).collect()}
    assert got == linked(texts)


def test_ngram_join_in_a_hot_group(spark):
    """Many near copies of one text, whose pairs differ in how close they are, and many texts with one passage."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(120):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 5)):
            w[p] = f"e{i}_{p}"
        texts[i] = " ".join(w)
    for i in range(120, 200):
        texts[i] = " ".join([f"u{i}_{k}" for k in range(60)] + base[:50])
    texts[200], texts[201], texts[202] = None, "a b", "A  B"
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in ngram_join.near_duplicates(d).collect()}
    assert got == linked(texts)


def test_ngram_join_awkward_rows(spark):
    d = awkward(spark)
    got = table(ngram_join.near_duplicates(d))
    by = {r.doc_id: r for r in got.itertuples()}
    assert len(got) == d.count() and by[1].component_id == 1 and by[2].component_id == 2 and by[5].component_id == 4 and by[7].component_id == 6
    assert ngram_join.near_duplicates(d.limit(0)).count() == 0


def test_ngram_join_with_repeated_and_null_ids(spark):
    """Each row links by its own text, whatever its doc_id."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one), (7, two), (3, one + " x"), (9, two + " y"), (None, one + " z"), (None, "c d e f g h"), (None, "c d e f g h i"), (5, " "), (5, None)]
    got = sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(7, 36, 3), (7, 36, 7), (3, 37, 3), (9, 37, 7), (None, 37, 3), (None, 2, None), (None, 3, None), (5, 0, 5), (5, 0, 5)]
    assert got == sorted(want, key=str)


def test_sketches_differ_no_more_than_the_sets(spark):
    rng = np.random.default_rng(8)
    a = [f"w{i}" for i in range(300)]
    texts = [" ".join(a)] + [" ".join(x if rng.random() > 0.02 * k else f"n{k}" for x in a) for k in range(12)]
    w = Words(pa.array(texts))
    s = ngram_join.Shingles(w, w.hashes(), np.arange(13), 5)
    bits = np.unpackbits(ngram_join.sketches(s, 13).view(np.uint8), axis=1)
    sets = [set(s.value[s.first[i] : s.first[i + 1]].tolist()) for i in range(13)]
    apart = [(len(sets[0] ^ x), int((bits[0] != b).sum())) for x, b in zip(sets, bits)]
    assert all(b <= n and (n - b) % 2 == 0 for n, b in apart) and apart[1][0] == 0 and apart[-1][1] > 100


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["component_id"] for r in components(stored(spark.createDataFrame(edges, "a long, b long"), "e")).collect()}
    assert got == {x: find(x) for x in root}


# -- language identification --------------------------------------------------------------------------------------------


def test_language_id_accuracy(spark):
    got = table(QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"))
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def cross_parse(sample, text):
    """Phrases by search for the longest piece at each place."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_are_longest_matches_across_white_space(spark, texts, monkeypatch):
    samples = [" the quick brown fox jumps over the lazy dog ", " the cat and the dog ", " " + " ".join(sorted({x.lower() for t in list(texts.values())[:20] for x in words(t)})) + " "]
    cases = ["the quick brown fox jumps over the lazy dog", "the  cat\tand", "qq", "dogcat and the", "", None, "\u0416 the", "x" * 700, "the quick brown fox " * 90, *list(texts.values())[:40]]
    parser = language_id.Parser([language_id.Automaton(x) for x in samples])
    plain = language_id.normalised(pa.array(cases)).to_pylist()
    want = [[cross_parse(x, t) for t in plain] for x in samples]
    assert want[0][0] == 1
    for chunk in (512, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        letters = parser.numbers(np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32))
        assert parser.phrases(letters, np.array([len(t) for t in plain])).tolist() == want


def test_language_prediction_and_score_against_brute_force(spark):
    samples = {"aa": " the river and the road to the town ", "bb": " der fluss und die strasse zur stadt ", "cc": " la riviere et la route de la ville "}
    rows = [(1, "The river, the road"), (2, "die  Stadt und der Fluss"), (3, "la route et 12"), (4, "12 34"), (5, "\u0416\u0416 road"), (6, None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), {k: language_id.Automaton(v) for k, v in samples.items()}).collect()}
    for i, text in rows:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        plain, bits = f" {' '.join(text.lower().split())} ", {}
        for k, sample in samples.items():
            lacks = sum(c not in sample for c in plain)
            bits[k] = (cross_parse(sample, plain) - lacks) * math.log2(len(sample)) + lacks * language_id.LITERAL
        low, high = sorted(bits.values())[:2]
        assert got[i]["lang_pred"] == min(bits, key=bits.get) and got[i]["score"] == pytest.approx(high / (low + high))


def test_language_samples_are_whole_texts(spark, monkeypatch):
    seen = spark.createDataFrame([(i, f"word{i} " * (30 if i else 4000), "en") for i in range(9)], "doc_id long, text string, lang string")
    model = language_id.automata(seen, rows=5, chars=2_000)["en"]
    assert 2 ** model.bits <= 2_100
    only = language_id.automata(seen.filter("doc_id = 0"), chars=2_000)["en"]
    assert 2 ** only.bits > 20_000


def test_language_id_awkward_rows(spark):
    d = awkward(spark)
    models = language_id.automata(d)
    got = table(language_id.identify(d, models))
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[1].lang_pred == by[2].lang_pred == by[8].lang_pred == "und" and by[8].score == 0
    assert set(table(language_id.identify(d, {})).lang_pred) == {"und"} and language_id.automata(d.limit(0)) == {}
    assert language_id.identify(d.limit(0), models).count() == 0


# -- context-tree weighting ---------------------------------------------------------------------------------------------


def test_ctw_base_and_held_out(spark, texts):
    got = table(QUERIES["op4_ctw"](spark, SF))
    tokens = {i: [*words((t or "").translate(LOWER)), "\n"] for i, t in texts.items()}
    train = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(w)
    n, v = sum(train.values()), len(train)
    for r in got.itertuples():
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score < 0
    assert got[got.held_out].bits_per_byte.mean() < 3.5


def brute_ctw(train, text, depth):
    """Direct definition: trees as dictionaries, weights by recursion."""
    pad = b"\n" * depth
    nodes = collections.defaultdict(lambda: [0, 0])

    def decisions(byte):
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield node, bit
            node = node * 2 + bit

    for t in train:
        s = pad + t + b"\n"
        for i in range(depth, len(s)):
            for node, bit in decisions(s[i]):
                for d in range(depth + 1):
                    nodes[s[i - d : i], node][bit] += 1

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    kids = collections.defaultdict(list)
    for c, node in nodes:
        if c:
            kids[c[1:], node].append((c, node))
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*nodes[key])
            memo[key] = own if len(key[0]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(map(weighted, kids[key])))
        return memo[key]

    s, total = pad + text + b"\n", 0.0
    for i in range(depth, len(s)):
        for node, bit in decisions(s[i]):
            p = None
            for d in range(depth, -1, -1):
                key = (s[i - d : i], node)
                if key not in nodes:
                    continue
                z, o = nodes[key]
                own = (o + 0.5) / (z + o + 1)
                beta = 1.0 if d == depth else math.exp(math.log(0.5) + kt(z, o) - weighted(key))
                p = own if p is None else beta * own + (1 - beta) * p
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
    return total


def test_ctw_against_its_definition(spark):
    train = ["the cat sat on the mat", "a cat and a dog", "the dog sat", "on and on"]
    rows = [(i, t, False) for i, t in enumerate(train)] + [(9, "The  cat and the frog", True), (10, None, True)]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    for i, text in ((9, b"the cat and the frog"), (0, b"the cat sat on the mat"), (10, b"")):
        assert got[i] == pytest.approx(brute_ctw([t.encode() for t in train], text, ctw.DEPTH), rel=1e-5)


def test_ctw_awkward_rows(spark):
    d = awkward(spark).withColumn("held_out", F.col("doc_id").isNull())
    assert ctw.score(d).count() == d.count()
    assert ctw.score(d.withColumn("held_out", F.lit(True))).filter("score < 0").count() == d.count()
    assert ctw.score(d.limit(0)).count() == 0


# -- embeddings -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim", [16, 64])
def test_embedding_recall(spark, dim):
    """Planted pairs with cosines from 0.98 to 1 among many far vectors, against brute force."""
    rng = np.random.default_rng(dim)
    far = rng.normal(size=(4000, dim))
    some = far[rng.permutation(4000)[:600]]
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    side = rng.normal(size=some.shape)
    side -= (side * some).sum(axis=1, keepdims=True) * some
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.9999, (600, 1))
    x = np.float32(np.concatenate([far, cosine * some + np.sqrt(1 - cosine**2) * side]))
    label = np.concatenate([np.zeros(4000, int), rng.integers(0, 8, 600) // 7])
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    got = table(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).set_index("vec_id").sort_index()
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    true, found = near.sum(axis=1), got.n_links.to_numpy()
    assert true.sum() > 800 and (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert (got.kept == (got.index == got.component_id)).all()


def test_embeddings_awkward_rows(spark):
    v = [0.1, -0.2, 0.3, 0.4]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 4, 1), (7, [float("nan"), 1.0, 0.0, 0.0], 1), (8, [None, 1.0, 0.0, 0.0], 1), (9, [x * 3 for x in v], 1), (10, v[:2], 1), (11, [], 1), (12, [float("inf")] * 4, 1)]
    rows += [(100 + i, [0.1 + 1e-5 * i, -0.2, 0.3, 0.4], 1) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"filters": F.lit(1), "copies": F.lit(1)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    assert got[2]["component_id"] == got[9]["component_id"] == got[129]["component_id"] == 1 and got[1]["n_links"] == got[9]["n_links"] == 32
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (3, 4, 5, 6, 7, 8, 10, 11, 12))
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_hot_filters_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(scale=0.02, size=16)], 1) for i in range(60)]
    got = table(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).set_index("vec_id").sort_index()
    x = np.array([np.float32(r[1]) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert (got.n_links.to_numpy() == near.sum(axis=1) - 1).all() and (got.component_id == 0).all()


# -- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_targets(spark):
    got = table(QUERIES["op9_mixing"](spark, SF))
    size = {r["doc_id"]: len(words(r["text"])) for r in docs(spark).collect()}
    assert all(size[i] == n for i, n in zip(got.doc_id, got["size"])) and len(got) == len(size)
    size_of = {k: g["size"] for k, g in got.groupby("source", dropna=False)}
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per.index))}
    target, open_ = dict.fromkeys(per.index, 0.0), set(per.index)
    left = 1.5 * per["size"].sum()
    while left > 1e-6 and open_:
        total, more = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= 2 * per["size"][s]:
                more += target[s] - 2 * per["size"][s]
                target[s] = 2.0 * per["size"][s]
                open_.discard(s)
        left = more
    for s, r in per.iterrows():
        assert r.own == r["size"] and r.target == pytest.approx(target[s], rel=1e-9)
        mean = size_of[s].mean()
        short = size_of[s][size_of[s] <= mean]
        assert abs(r.taken - r.target) <= (short.max() if len(short) and r.most > mean else r.most)
    assert (got.taken <= 2 * got["size"]).all()
    again = table(QUERIES["op9_mixing"](spark, SF))
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_is_close_on_large_sources(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(n)), "s%d" % (i % 3)) for i, n in enumerate(rng.pareto(1.3, 3000) * 10 + 1)]
    got = table(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) / per.target < 0.002).all()


def test_mixing_does_not_depend_on_partitions(spark):
    key = lambda r: tuple(map(str, r))
    first, other = (sorted(map(key, mixing.repeated(docs(spark).repartition(n, "n_chars")).select("doc_id", "source").collect())) for n in (2, 7))
    assert first == other


def test_mixing_awkward_rows(spark):
    d = awkward(spark)
    got = table(mixing.mix(d))
    assert len(got) == d.count() and (got[got["size"] == 0].taken == 0).all()
    rows = mixing.repeated(d)
    assert rows.columns == d.columns and rows.count() == got.copies[got["size"] > 0].sum()
    assert mixing.mix(d.limit(0)).count() == 0


# -- token counts and quality ----------------------------------------------------------------------------------------


def test_token_counts(spark, texts):
    got = {r[0]: r[1] for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    encoder = token_counts._encoder(token_counts.TOKENIZER)
    assert got == {i: len(encoder.encode_ordinary(t or "")) for i, t in texts.items()}


def test_separators_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(7)
    lengths, flat = rng.integers(0, 60, 40).tolist(), []
    for n in lengths:
        flat += [int(x) for x in rng.integers(0, 9, n)] + [9]
    np.array([*flat, 1, 2], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = table(token_counts.token_counts(token_counts.read_flat(spark, str(tmp_path), 34), 9)).sort_values("doc_no")
    a = got[got.file.str.endswith("a.bin")]
    assert a.n_tokens.tolist() == [*lengths, 2] and a.closed.tolist() == [True] * 40 + [False]


def test_token_counts_awkward_rows(spark):
    d = awkward(spark)
    f = token_counts.write_token_files(d)
    assert token_counts.token_counts(f).count() == d.count()
    assert token_counts.token_counts(token_counts.write_token_files(d.limit(0))).count() == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = table(QUERIES["op1_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"))
    assert ((got.quality == 1) == got.kept).mean() > 0.95 and got[got.quality == 1].kept.mean() > 0.98


def brute_em(patterns, counts, rounds):
    """The estimation written out with dictionaries."""
    votes = {p: [p // 3**k % 3 - 1 for k in range(len(quality.VOTES))] for p in patterns}
    post = {p: 1 / (1 + math.exp(-(sum(x > 0 for x in v) - quality.CAUTION * sum(x < 0 for x in v)))) for p, v in votes.items()}
    for _ in range(rounds):
        good = {p: counts[p] * post[p] for p in patterns}
        bad = {p: counts[p] * (1 - post[p]) for p in patterns}
        prior = min(0.98, max(0.02, sum(good.values()) / sum(counts.values())))
        chance = []
        for mass in (good, bad):
            rows = [[1 + sum(mass[p] for p in patterns if votes[p][k] == s) for s in (-1, 0, 1)] for k in range(len(quality.VOTES))]
            chance.append([[x / sum(r) for x in r] for r in rows])
        for p, v in votes.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[0][k][x + 1] / chance[1][k][x + 1]) for k, x in enumerate(v))
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def test_quality_estimation_against_brute_force():
    rng = np.random.default_rng(9)
    good = rng.random(2000) < 0.7
    v = np.zeros((2000, len(quality.VOTES)), int)
    for k, (*_, under, over) in enumerate(quality.VOTES):
        says = sorted({0, under, over})
        right = rng.random(2000) < 0.8
        v[:, k] = np.where(good == right, max(says), min(says))
    patterns, counts = np.unique(quality.pattern_of(v), return_counts=True)
    got = quality.weak_labels(patterns, counts.astype(float), rounds=12)
    want = brute_em(patterns.tolist(), dict(zip(patterns.tolist(), counts.tolist())), 12)
    assert np.allclose(got, [want[p] for p in patterns.tolist()])


def test_quality_scorer_learns_its_targets():
    """Loss falls to what the features allow, and the gradient at the end is small beside the start's."""
    texts = [f"good plain words number {i}. and more of them." for i in range(60)] + [f"$$ ## {i} | | ~ ^" for i in range(60)]
    w, target = Words(pa.array(texts)), np.repeat([0.9, 0.1], 60)
    x = quality.features(w)
    scorer = quality.Scorer(x, *quality.condensed(w), target)
    assert np.abs(scorer.score(w) - target).max() < 0.1


def test_quality_awkward_rows(spark):
    d = awkward(spark)
    got = table(quality.classify(d))
    assert len(got) == d.count() and not got[got.doc_id.isin([1, 2, 3])].kept.any() and got.score.between(0, 1).all()
    assert quality.classify(d.limit(0)).count() == 0


def test_words_of_bytes():
    w = Words(pa.array(["a  B\tc", None, "", " é\x0b", "x"]), lower=True)
    assert w.count.tolist() == [3, 0, 0, 1, 1]
    other = Words(pa.array(["zz b", "X"]), lower=True)
    assert w.hashes()[1] == other.hashes()[1] and w.hashes()[4] == other.hashes()[2]
