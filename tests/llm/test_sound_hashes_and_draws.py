"""Crafted words that hashes modulo a power of two confuse, training draws among many copies, and rare marks."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from popspark.llm import bpe, common, ctw, language_id, ngram_join, quality, substring_dedup
from popspark.llm.common import Words

SCHEMA = "doc_id long, text string"


def thue(n, letters="ab"):
    """The Thue-Morse word of 2 ** n letters and its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return [word.translate(str.maketrans("ab", x)) for x in (letters, letters[::-1])]


def test_hashes_of_crafted_words():
    for n in (10, 11, 12, 13):
        one, two = thue(n)
        w = Words(pa.array([one, two, f"x {one} y", " ".join(one), " ".join(two)]))
        for which in (0, 1):
            h = w.hashes(which)
            assert h[0] != h[1] and h[0] == h[3]
            whole = w.whole(which)
            assert whole[3] != whole[4]
            at = w.first[3:5]
            size = np.array([2**n, 2**n])
            assert len(set(w.spans(h, at, at + size).tolist())) == 2


def test_hashes_do_not_depend_on_place_or_neighbours(monkeypatch):
    rng = random.Random(1)
    said = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 5, 9, 300]))) for _ in range(800)]
    text = "  ".join(said)
    w = Words(pa.array(["first one", text, None, text]))
    value, joined = w.hashes(), w.joined(w.hashes(), 5)
    seen = {}
    for word, h in zip([*"first one".split(), *said, *said], value.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    n = len(said)
    assert (joined[2 : 2 + n - 4] == joined[2 + n : 2 + 2 * n - 4]).all() and w.whole()[1] == w.whole()[3]
    monkeypatch.setattr(common, "CACHED", 64)  # blocks change nothing
    again = Words(pa.array(["first one", text, None, text]))
    assert (again.hashes() == value).all() and (again.joined(value, 5) == joined).all()
    x = np.array([rng.randrange(common.PRIME) for _ in range(300)], np.uint64)
    assert common.times(x, x[::-1]).tolist() == [int(a) * int(b) % common.PRIME for a, b in zip(x, x[::-1])]


def test_crafted_words_stay_apart(spark):
    one, two = thue(12)
    joined = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark.createDataFrame([(1, one), (2, two), (3, two)], SCHEMA)).collect()}
    assert [joined[k]["component_id"] for k in (1, 2, 3)] == [1, 2, 2]
    rest = [f"w{k}" for k in range(19)]
    texts = [" ".join([one, *rest]), " ".join([two, *rest]), " ".join([two, *rest])]
    gone = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert gone == {0: 0, 1: 0, 2: 20}


def test_crafted_words_are_counted_apart(spark):
    one, two = thue(11)
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 != 1][:2]
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    docs = spark.createDataFrame([(ids[0], one), (ids[1], "other"), (held, two)], SCHEMA)
    rows = {r["doc_id"]: r for r in ctw.score(docs.withColumn("held_out", F.col("doc_id") == held)).collect()}
    assert rows[held]["n_known"] == 1 and rows[ids[0]]["n_known"] == 2  # the end alone is known


def test_language_draw_keeps_languages_of_few_texts(spark):
    rng = random.Random(2)
    say = lambda x: " ".join("".join(rng.choice(x) for _ in range(6)) for _ in range(30))
    rows = [("en", say("abcdef")) for _ in range(300)] + [("fr", say("ghijkl"))] * 5000 + [("de", t) for t in (say("mnopqr"), say("mnopqr"), say("mnopqr")) for _ in range(1700)]
    models = language_id.automata(spark.createDataFrame(rows, "lang string, text string"))
    assert sorted(models) == ["de", "en", "fr"]


def test_quality_is_not_trained_on_copies(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    drawn = quality.sample(docs).orderBy("rank", "tie")
    first = drawn.first()["text"]
    copies = docs.unionByName(spark.range(4000).select((F.col("id") + 10**9).alias("doc_id"), F.lit(first).alias("text")))
    assert quality.sample(copies).count() == drawn.count() == docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().count()
    right = lambda d: quality.classify(d).join(labels, "doc_id").agg(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
    plain = right(docs)
    assert plain > 0.9 and right(copies) > plain - 0.03


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"{k} " * (5 if k else 5000)) for k in range(50)], SCHEMA)
    assert quality.sample(docs, rows=7).count() == 7
    got = quality.sample(docs, rows=50, size=600).collect()
    assert got and sum(len(r["text"]) for r in got) <= 600 and all(len(r["text"]) < 100 for r in got)
    assert quality.sample(docs.limit(0)).count() == 0


def test_bpe_normalises_marks_as_the_library_does():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    marks = [c for c in every if unicodedata.category(c)[0] == "M"]
    letters = [c for c in every if unicodedata.category(c)[0] == "L"]
    parts = [unicodedata.normalize("NFD", c) for c in every if unicodedata.decomposition(c)]
    rng = random.Random(5)
    pick = (lambda: rng.choice(marks), lambda: rng.choice(marks), lambda: rng.choice(letters), lambda: rng.choice("aeiou n"), lambda: rng.choice(parts))
    cases = ["aⷴ\U00011070", "a\U00010eac⃦", "a̳᫂", "\U00011935\U00011930"]
    cases += ["".join(rng.choice(pick)() for _ in range(rng.randint(2, 8))) for _ in range(50_000)]
    for text, got, want in zip(cases, own.encode(cases), lib.encode_batch(cases, add_special_tokens=False)):
        assert [int(i) for e in got for i in e[0].split()] == want.ids, ascii(text)


def test_words_are_encoded_once_for_all_chunks(monkeypatch):
    """Marks around a word and later batches do not encode it again, and results do not change when the memory is emptied."""
    from popspark.llm import bpe

    one = bpe.WordBpe(bpe.tokenizer_path())
    seen = []
    encode = one.encode_words
    monkeypatch.setattr(one, "encode_words", lambda words: seen.extend(words) or encode(words))
    texts = ["zyxgrub, zyxgrub. (zyxgrub)", "Zyxgrub! éclair ẞ"]
    first = [one.encode([t]) for t in texts]
    assert seen.count("zyxgrub") == 1
    monkeypatch.setattr(bpe, "WORDS", 0)
    monkeypatch.setattr(bpe, "MEMORY", 0)
    assert [one.encode([t]) for t in texts] == first and seen.count("zyxgrub") > 1
