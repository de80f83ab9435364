"""Vector codes, fingerprints and conversation repair against plain versions, with awkward rows."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
from compare import same

from popspark.llm import conversations, fingerprints, vector_codes

SF = "/root/testdata/sf0.001"
VECTOR = "vec_id long, embedding array<float>, label int, code string"
TURN = "conv_id long, turn long, role string, text string, conv string"
DOC = "doc_id long, text string, tie long, fingerprint string"


def test_codes_as_sql(spark):
    same(spark, vector_codes.op13_vector_codes, vector_codes.SQL, SF)


def _nearest(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(6))
def test_equal_average_is_exact(seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-4, 4, (40, 1 + seed)).astype(np.int64)  # many ties and equal entries
    x = rng.integers(-5, 5, (300, 1 + seed)).astype(np.int64)
    at, d = vector_codes.EqualAverage(book).nearest(x)
    want, least = _nearest(x, book)
    assert (d == least).all() and (at == want).all()


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.2, 0.3, 0.5, 1.0, 2.0, 0.0, -1.0], 1, "x"), (2, None, 1, "x"), (3, [nan] * 8, 1, "x"), (4, [0.5, None] * 4, 1, "x"), (5, [inf] + [0.0] * 7, 2, "x"), (6, [1.0, 2.0], 1, "x")]
    rows += [(None, [0.1] * 8, None, "x"), (7, [3e38] * 8, None, "x"), (8, [0.25] * 8, 1, "x"), (8, [0.25] * 8, 1, "x"), (9, [], 3, "x")]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, VECTOR))
    got = sorted(codes.collect(), key=str)
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "6", "7", "8", "8", "9", "None"]
    by_id = {r["vec_id"]: r for r in got}
    assert by_id[6]["code"] is None and by_id[9]["error"] is None and by_id[1]["error"] == 0
    assert all(len(b) == 5 and b.shape[1] == 2 for b in books)
    back = {r["vec_id"]: r["approx"] for r in vector_codes.decode(codes, books).collect()}
    assert back[8] == [0.25] * 8 and back[6] is None
    empty, none = vector_codes.compress(spark.createDataFrame([], VECTOR))
    assert empty.count() == 0


def _brute_repair(rows):
    """Cheapest (cost, audit, lines) over all edits of a short conversation, by search in order of cost."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.strip(conversations.BLANKS)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        kept = [(e, r, t, f) for e, (r, t), f in zip(edits, rows, faults) if e != "D"]
        for new in itertools.product("ua", repeat=sum(e == "R" for e in edits)):
            new, base = list(new), 3 * edits.count("D") + 2 * edits.count("R") + sum(f == "truncated" for *_, f in kept)
            seq = [new.pop(0) if e == "R" else r[:1] for e, r, *_ in kept]
            for ins in itertools.product(range(3), repeat=len(rows) + 1):  # insertions before each row and at the end
                cost = base + 2 * sum(ins)
                if best and cost > best[0]:
                    continue
                audit, shape, k = "", "", 0
                for at, n in enumerate(ins):
                    audit, shape = audit + "I" * n, shape + "?" * n
                    if at < len(rows):
                        audit += edits[at]
                        if edits[at] != "D":
                            shape, k = shape + (seq[k] or "!"), k + 1
                full = re.fullmatch(r"(s?(ua)+)?", _filled(shape))
                if full and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, shape
    return best[:2]


def _filled(shape):
    """Insertions as the role that alternation asks for."""
    begin = 1 if shape[:1] == "s" else 0
    return "".join("ua"[(k - begin) % 2] if x == "?" else x for k, x in enumerate(shape))


@pytest.mark.parametrize("seed", range(25))
def test_repair_is_cheapest(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", "user", "assistant"], ["a.", "b", " ", "c!", "d.", "e?", "f."]
    rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 4))]
    g = conversations.Grammar()
    found = conversations.faults([r for r, _ in rows], [t for _, t in rows])
    cost, audit, edited, _ = conversations.cheapest(g, conversations.parse(g, [(r[:1], f) for (r, _), f in zip(rows, found)]))
    assert (cost, audit) == _brute_repair(rows)


def test_repair_as_sql(spark):
    same(spark, conversations.op11_conversation_repair, conversations.SQL, SF)


def test_repair_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["a.", "b", " ", "c!", "d.", "e?", *[f"{k} said." for k in range(40)]]
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, *texts]), "x") for _ in range(300)]
    rows += [(5, 1, "user", "once again.", "x")] * 40
    df = spark.createDataFrame(rows, TURN)
    # one plain pass over each conversation
    want, g = {}, conversations.Grammar()
    for conv in {r[0] for r in rows}:
        own = [(t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x, _ in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        roles, said = [r[1] for r in own], [r[2] for r in own]
        found = conversations.faults(roles, said)
        cost, audit, edited, _ = conversations.cheapest(g, conversations.parse(g, [(r[:1], f) for r, f in zip(roles, found)]))
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(conversations.lines(audit, edited, roles, said)).encode()).hexdigest()
        want["" if conv is None else f"={conv}"] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), cost, audit, digest)
    for size in (1000, 7):
        monkeypatch.setattr(conversations, "BLOCK_ROWS", size)
        got = {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["cost"], r["audit"], r["repaired_sha256"]) for r in conversations.repair(df).collect()}
        assert got == want
    assert conversations.repair(df.limit(0)).count() == 0


def test_other_grammar():
    g = conversations.Grammar((("C", ""), ("C", "Cu"), ("C", "Ca")))  # any order of user and assistant
    assert conversations.cheapest(g, conversations.parse(g, [("u", ""), ("u", ""), ("a", "")]))[:2] == (0, "KKK")


def test_spans_against_texts():
    rng = random.Random(1)
    texts = ["", "a", "".join(rng.choice("ab") for _ in range(3000)), "é" * 50 + "\U0001f600" * 20, "abba" * 700]
    texts.append(texts[2][:1200] + "c" + texts[2][1200:])
    p = fingerprints.Prefixes(texts)
    flat = "".join(texts)
    a, b = np.array([rng.randrange(len(flat)) for _ in range(400)]), np.array([rng.randrange(len(flat)) for _ in range(400)])
    most = len(flat) - np.maximum(a, b)
    assert p.extension(a, b, most).tolist() == [len(os.path.commonprefix([flat[x:], flat[y:]])) for x, y in zip(a, b)]
    size = np.minimum(most, 5)
    assert p.equal(a, b, size).tolist() == [flat[x : x + n] == flat[y : y + n] for x, y, n in zip(a, b, size)]
    x = np.array([rng.randrange(fingerprints.PRIME) for _ in range(200)], np.uint64)
    y = np.array([rng.randrange(fingerprints.PRIME) for _ in range(200)], np.uint64)
    assert fingerprints.times(x, y).tolist() == [int(u) * int(v) % fingerprints.PRIME for u, v in zip(x, y)]
    value = 0
    for k, c in enumerate(texts[3]):
        value = (value + (ord(c) + 1) * pow(fingerprints.BASE, k, fingerprints.PRIME)) % fingerprints.PRIME
    assert int(p.spans(p.at[3:4], p.at[4:5])[0]) == value


def test_no_equal_spans_of_crafted_texts():
    """Texts that any polynomial modulo a power of two confuses."""
    thue = "a"
    for _ in range(12):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    one, two = fingerprints.prints(fingerprints.Prefixes([thue, other]))
    assert one.split(".")[1] != two.split(".")[1]


def test_likeness_of_edits():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    text = " ".join(rng.choice(words) for _ in range(1500))
    far = " ".join(rng.choice(words) for _ in range(1500))
    texts = [text, text[:2000] + "inserted" + text[2000:], "new beginning " + text + " new ending", text[: len(text) // 2], far, "", text]
    made = fingerprints.prints(fingerprints.Prefixes(texts))
    near = [fingerprints.likeness(made[0], m) for m in made]
    assert near[0] == near[6] == 1.0 and min(near[1:3]) > 0.8 and 0.35 < near[3] < 0.85 and near[4] < 0.2 and near[5] == 0.0
    assert fingerprints.likeness(made[5], made[5]) == 1.0 and made[0] == made[6]


def _plain(docs):
    """n_chars, digest, common extensions by doc, in order."""
    out = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(os.path.commonprefix([text, edited])), len(os.path.commonprefix([text, after]))))
    return out


@pytest.mark.parametrize("block", [16_000_000, 2_000])
def test_edited_texts(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", block)
    monkeypatch.setattr(fingerprints, "HELD", 700)
    rng = random.Random(4)
    texts = [None, "", "x", "abcd", "é€\U0001f600" * 30, "long " * 3000, *["".join(rng.choice("abc ") for _ in range(rng.randint(0, 400))) for _ in range(120)]]
    rows = [(k * 3 + 2**60, t, 5, "x") for k, t in enumerate(texts)] + [(None, "none", 1, "x")]
    rng.shuffle(rows)
    got = fingerprints.edited_likeness(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["common_edited"], r["common_next"]) for r in got), key=key) == _plain(order)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {fingerprints.prints(fingerprints.Prefixes([""]))[0]}


def test_few_and_repeated_documents(spark):
    one = fingerprints.edited_likeness(spark.createDataFrame([(7, "alone here", 1, "x")], DOC)).collect()
    assert [(r["doc_id"], r["near_next"], r["common_next"]) for r in one] == [(7, 1.0, 10)]
    many = fingerprints.edited_likeness(spark.createDataFrame([(7, "same", 1, "x")] * 30 + [(None, "same", 1, "x")] * 30, DOC)).collect()
    assert len(many) == 60 and all(r["near_next"] == 1.0 for r in many)
    assert fingerprints.edited_likeness(spark.createDataFrame([], DOC)).count() == 0
    assert fingerprints.fingerprints(spark.createDataFrame([(1, None, 1, "x")], DOC)).first()["n_chars"] == 0


def test_likeness_and_extension_columns(spark):
    made = fingerprints.prints(fingerprints.Prefixes(["some words here", "some words there"]))
    got = fingerprints.with_likeness(spark.createDataFrame([(made[0], made[0]), (made[0], made[1]), (None, made[1])], "a string, b string"), "a", "b").collect()
    assert got[0]["likeness"] == 1.0 and 0.5 < got[1]["likeness"] < 1 and got[2]["likeness"] is None
    pairs = spark.createDataFrame([("abcdef", 1, "xbcdz", 1), ("ab", 2, "ab", 0), ("ab", 3, "ab", 0), (None, 0, "a", 0)], "a_text string, a_at long, b_text string, b_at long")
    assert [r["extension"] for r in fingerprints.common_extensions(pairs).collect()] == [3, 0, None, None]


def test_fingerprint_query_over_the_table(spark):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    got = fingerprints.op12_fingerprints(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["common_edited"], r["common_next"]) for r in got) == _plain(docs)
    assert min(r["near_edited"] for r in got) > 0.5
