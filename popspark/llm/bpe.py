"""BPE encoding and decoding: greedy longest match proposes, a vectorised test verifies, few words are merged exactly.

A split of a word into tokens is the BPE result exactly when every two neighbours are compatible, that is, when
no merge of higher rank would have crossed their border.  So: (1) each new word of a batch is cut greedily into
the longest vocabulary entries; (2) all adjacent pairs of all new words are tested at once with NumPy; (3) words
with an incompatible pair, and only they, go through exact merging.  A word is encoded once for each batch of
rows, and words, not documents, are what the inner loop sees, so a long text costs no more than its words.

Defined results: null text counts as empty and gives no ids; special-token strings in a text become their ids, as
the public library does by default; ids outside the vocabulary decode to nothing; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import string
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from popspark.llm.common import byte_slices, documents

TOKENIZER = "word_bpe_49k.json"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end-of-word marker inside the trie.
END = "\ue000"
#: Chunks that a worker remembers between batches; beyond it the memory is emptied, results do not change.
MEMORY = 400_000
#: The same for words without the marks around them, which several chunks share.
WORDS = 400_000
#: Lengths in bytes up to which words are merged in one matrix, and the fewest words for which that pays.
BANDS, FEW = (8, 16, 32, 64), 32
#: A chunk of letters and one of these is a word and a mark.
MARKS = frozenset(string.punctuation)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _foreign(normal, every: str) -> set[str]:
    """Characters that Python's NFC reorders or composes and the library's ``normal`` does not, or otherwise."""
    mine = lambda x: unicodedata.normalize("NFC", x)

    def told_apart(pairs: list[str]) -> list[bool]:
        """All at once, between line ends, which nothing composes with."""
        return [a != b for a, b in zip(normal("\n".join(pairs)).split("\n"), mine("\n".join(pairs)).split("\n"))]

    made = [unicodedata.normalize("NFD", c) for c in every if unicodedata.decomposition(c) and unicodedata.normalize("NFD", c) != c]
    made = [m for m in made if len(m) > 1]
    found = {c for m, apart in zip(made, told_apart(made)) if apart for c in m[1:]}
    marks = [c for c in every if unicodedata.combining(c)]
    least = {unicodedata.combining(c): c for c in reversed(marks)}
    # marks against old ones of the most usual classes, then against one of each class that passes
    for known in ((1, 220, 230, 240), [k for k, c in least.items() if c not in found]):
        known = [least[k] for k in known if k in least and least[k] not in found]
        pairs = [(m, p) for m in marks if m not in found for r in known for p in (m + r, r + m)]
        found |= {m for (m, _), apart in zip(pairs, told_apart([p for _, p in pairs])) if apart}
    return found


class Recent:
    """Characters that Python's Unicode tables lack, or the library's: how the public library lowers, composes and classes them."""

    def __init__(self):
        from tokenizers import Regex, normalizers

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        mine = [c for c in regex.findall(r"[\p{L}\p{N}\p{M}]", every) if unicodedata.category(c) == "Cn"]
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        rare = sorted({*mine, *_foreign(normalizers.NFC().normalize_str, every)})
        self.any = regex.compile(f"[{_ranges(rare)}]") if rare else regex.compile("(?!)")
        self.rare = frozenset(rare)  # the same characters: a set tells sooner than the class whether a text has one
        # those that this module takes for letters or numbers but the library does not
        other = normalizers.Replace(Regex(r"[\p{L}\p{N}]"), "").normalize_str("".join(mine))
        other = regex.findall(r"[\p{L}\p{N}]", other)
        split = regex.sub(r"\\p\{([LN])\}", rf"[\\p{{\1}}--[{_ranges(other)}]]", PATTERN) if other else PATTERN
        self.pattern = regex.compile(split, regex.V1 if other else 0)


def _ranges(letters: list[str]) -> str:
    """The inside of a character class for letters in order."""
    cuts = [0, *(i for i in range(1, len(letters)) if ord(letters[i]) > ord(letters[i - 1]) + 1), len(letters)]
    return "".join([f"{letters[a]}-{letters[b - 1]}" for a, b in zip(cuts, cuts[1:])])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary whose words end in a marker and whose ids above the letters follow the order of the merges."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.marker = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.size = max(self.tokens) + 1
        # parts of each token; a letter is its own part
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[made], self.right[made] = left, right
        self.order = {p: r for r, p in enumerate(zip(left.tolist(), right.tolist()))}
        self.made = made.tolist()
        # order in which tokens come to be: letters first, then by merge
        self.born = np.full(self.size, -1, np.int64)
        self.born[made] = np.arange(len(made))
        key = left * self.size + right
        order = np.argsort(key)
        self.pair_keys, self.pair_born = key[order], np.arange(len(made))[order]
        self.trie: dict = {}
        for text, i in self.vocab.items():
            node = self.trie
            for letter in text.removesuffix(self.marker) + END * text.endswith(self.marker):
                node = node.setdefault(letter, {})
            node[""] = i
        self.names = {i: str(i) for i in self.tokens}
        self.letters = byte_letters()
        # ids of bytes inside a word, and of its last one
        self.inner, self.last = (np.array([self.vocab[x + end] for x in self.letters], np.int64) for end in ("", self.marker))
        self.merged = np.array(self.made, np.int64)
        self.recent = Recent()
        self.pattern = self.recent.pattern
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.memory: dict[str | int, tuple[str, int, str]] = {}
        self.words: dict[str, tuple[str, int, str]] = {}

    # -- text to words ------------------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str | int]:
        """White-space-free pieces of a normalised text, which no token spans, and the ids of special tokens between them.

        Special tokens are found before letters are lowered: ``<|ENDOFTEXT|>`` is ordinary text.
        """
        out = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii() and not self.recent.rare.isdisjoint(part):
                part = self.recent.normal(part)
            elif not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # capital sigma is lowered without its context
            # str.split also cuts at four control characters that are not white space for the pattern
            out += part.lower().split() if not _CONTROL.search(part) else regex.split(r"\s+", part.lower())
        return [x for x in out if x != ""]

    def spell(self, word: str) -> list[str]:
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] += self.marker
        return letters

    # -- words to tokens ----------------------------------------------------------------------------------

    def greedy(self, word: str) -> list[int]:
        """Longest vocabulary entry at each place; single letters are always entries."""
        text = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])
        at, out, stop, root = 0, [], len(text), self.trie
        text += END
        while at < stop:
            node, found, i = root, None, at
            while (node := node.get(text[i])) is not None:
                i += 1
                # the last letter carries the marker, so an unmarked token may not reach the end
                if i != stop and (t := node.get("")) is not None:
                    found, end = t, i
                if i > stop:
                    break
            if found is None:
                raise ValueError(f"no entry for a letter of {word!r}")
            out.append(found)
            at = end
        return out

    def rank(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """Ranks of the merges of pairs, ``none`` where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_born[at], none)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of a + b gives back exactly (a, b), for all pairs at once.

        Undo the two tokens step by step, the later-born side first.  The two pieces that meet at the border
        would have merged if their pair has a merge that comes before either piece was used up.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        before_x = np.full(len(a), len(self.made), np.int64)  # when x and y stop being the pieces at the border
        before_y = before_x.copy()
        while len(live):
            born = self.rank(x, y, len(self.made) + 1)
            # of equal merges the left one goes first: a merge at the border precedes one to its right
            bad = (born < before_x) & (born <= before_y)
            ok[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            undo_x = go & (bx >= by)
            undo_y = go & ~undo_x
            before_x = np.where(undo_x, bx, before_x)
            before_y = np.where(undo_y, by, before_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)
            live, x, y, before_x, before_y = live[go], x[go], y[go], before_x[go], before_y[go]
        return ok

    def exact(self, word: str) -> list[int]:
        """Merge the best-ranked pair, leftmost first, until none is left."""
        ids = [self.vocab[x] for x in self.spell(word)]
        n = len(ids)
        if n > 64:
            return self.exact_long(ids)
        order, made, none = self.order, self.made, len(self.made)
        ranks = [order.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i : i + 2] = [made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = order.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = order.get((ids[i], ids[i + 1]), none)
        return ids

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, which keeps long words near-linear."""
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, self.made[r], p) for i in range(n - 1) if (r := self.order.get(p := (ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made, p = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (r := self.order.get(q := (ids[k], ids[nxt[k]]))) is not None:
                    heapq.heappush(heap, (r, k, self.made[r], q))
        return [t for t in ids if t >= 0]

    def exact_many(self, words: list[str]) -> list[list[int]]:
        """``exact`` of many words: in each round every word merges its best-ranked pair, the leftmost of equal ones."""
        coded = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        none, out = len(self.made), [[] for _ in words]
        for low, high in zip((0, *BANDS), BANDS):
            live = np.flatnonzero((size > low) & (size <= high))
            if not len(live):
                continue
            place, n = np.arange(high), size[live]
            raw, inside = np.zeros((len(live), high), np.uint8), place < n[:, None]
            raw[inside] = np.frombuffer(b"".join([coded[i] for i in live.tolist()]), np.uint8)
            ids = np.where(inside, self.inner[raw], -1)
            ends = np.arange(len(live)), n - 1
            ids[ends] = self.last[raw[ends]]
            ranks = np.full(ids.shape, none)  # of each place and the next
            pair = np.nonzero(inside[:, 1:])
            ranks[pair] = self.rank(ids[pair], ids[:, 1:][pair], none)
            while len(live):
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(live)), at]
                go = best < none
                for i, row in zip(live[~go].tolist(), ids[~go].tolist()):
                    out[i] = row[: row.index(-1)] if row[-1] < 0 else row
                live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
                rows = np.arange(len(live))
                # the second of the pair and its rank leave; what follows moves up
                ids[:, :-1] = np.where(place[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(place[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
                ids[:, -1], ranks[:, -1] = -1, none
                ids[rows, at] = self.merged[best]
                for first in (at - 1, at):
                    ok = (first >= 0) & (first < high - 1)
                    r, f = rows[ok], first[ok]
                    a, b = ids[r, f], ids[r, f + 1]
                    ranks[r, f] = np.where(b < 0, none, self.rank(a, b, none))
        for i in np.flatnonzero(size > BANDS[-1]).tolist():
            out[i] = self.exact(words[i])
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        proposed = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        failed = np.unique(owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]).tolist()
        wrong = [words[w] for w in failed]
        for w, ids in zip(failed, self.exact_many(wrong) if len(wrong) >= FEW else map(self.exact, wrong)):
            proposed[w] = ids
        return proposed

    # -- texts --------------------------------------------------------------------------------------------

    def learn(self, chunks: set[str | int]) -> None:
        """Remember ids (as text), their number and the decoded text of each chunk."""
        plain, parts = [], {}
        for c in chunks.difference(self.memory):
            if isinstance(c, int):
                self.memory[c] = self.entry([c])
            elif c.isalpha():
                plain.append(c)
            elif c[-1] in MARKS and c[:-1].isalpha():
                parts[c] = c[:-1], c[-1]
            else:
                parts[c] = self.pattern.findall(c)
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        fresh = [*set(plain).union(*parts.values()).difference(known)]
        known.update(zip(fresh, map(self.entry, self.encode_words(fresh))))
        self.memory.update(zip(plain, map(known.__getitem__, plain)))
        for c, own in parts.items():
            got = [known[w] for w in own]
            self.memory[c] = (" ".join([e[0] for e in got]), sum([e[1] for e in got]), " ".join([e[2] for e in got]))

    def entry(self, ids: list[int]) -> tuple[str, int, str]:
        return " ".join([self.names[t] for t in ids]), len(ids), " ".join([self.tokens[t] for t in ids])

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """For each text the remembered entry of each chunk; any chunk has ids, as the pattern leaves out nothing but white space."""
        cut = [self.chunks(t) for t in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        self.learn(set().union(*cut))
        return [list(map(self.memory.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[t] for t in ids if t in self.tokens])


#: Bytes of text that are encoded together; memory does not depend on how rows were batched.
BATCH = 1_000_000
_CONTROL = regex.compile("[\x1c-\x1f]")
_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
        gc.freeze()  # the vocabulary stays as long as the worker, so it need not be looked through again and again
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), n_tokens for each row."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = loaded(path)
        for b in byte_slices(batches, "text", BATCH):
            texts = [t or "" for t in b.column("text").to_pylist()]
            flat = [[int(x) for e in entries for x in e[0].split()] for entries in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(flat, pa.list_(pa.int32())), pa.array(map(len, flat), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, ids (array of int) and the digest of the decoded text for each row of ``docs``."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = loaded(path)
        for b in byte_slices(batches, "text", BATCH):
            rows = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            sizes = [sum([e[1] for e in r]) for r in rows]
            flat = np.fromstring(" ".join([e[0] for r in rows for e in r]), np.int32, sep=" ")
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
            sha = [hashlib.sha256(" ".join([e[2] for e in r]).encode("utf-8")).hexdigest() for r in rows]
            columns = [b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), ids, pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text for rows with doc_id and ids."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            texts = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode each row in one go and keep digests of both results."""
    path = path or tokenizer_path()

    def run(batches):
        bpe = loaded(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in byte_slices(batches, "text", BATCH):
            ids, texts = b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]
            rows = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([sum([e[1] for e in r]) for r in rows], pa.int64()),
                    pa.array([sha(" ".join([e[0] for e in r])) for r in rows]),
                    pa.array([sha(" ".join([e[2] for e in r])) for r in rows]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
