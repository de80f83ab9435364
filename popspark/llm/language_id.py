"""Language identification by cross-parsing entropy over suffix automata.

For each language the text of a bounded sample of labelled rows becomes a suffix automaton.  A text is parsed
against each automaton into phrases, each the longest piece, from where the last one ended, that occurs in the
sample, across words and white space; phrases times log2 of the sample's length, over the text's length, estimates
the bits for each character that the language needs.  The language that needs fewest wins.  A letter that the sample
lacks costs ``LITERAL`` bits in every language.

Parses run as NumPy arrays, one character of many chunks and all languages a step.  A chunk of a text is first parsed
as if a phrase began at its start.  Then the phrase that really reaches into it is followed until one of its
phrases begins where a phrase of the guess does; from there on both are the same.  A chunk in which that does not
happen hands its new state to the next one, until nothing changes, so the count is that of one parse of the whole text.

The sample of a language is whole texts of at most ``ROWS`` rows, as many of them as have ``CHARS`` characters
together (one row at least).  One task for each language builds its automaton; what the driver gets and ships is
bounded by these and the number of languages.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first language in
code-point order; an empty training set makes everything ``und``; repeated rows each get a row; further columns
pass through ``identify`` unread, those named like a result give way to it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popspark.llm.common import byte_slices, documents, folded

ROWS = 200
CHARS = 60_000
#: Bytes of text that are parsed together, and characters of a chunk; neither changes results.
BATCH = 1_500_000
CHUNK = 512
UNKNOWN = "und"
#: Bits of one letter out of all code points.
LITERAL = float(np.log2(0x110000))
#: Bits of a state's number in the table of arcs.
TARGET = 24
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton of a text as arrays of arcs (state, letter, state); state 0 is the root."""

    def __init__(self, text: str):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in map(ord, text):
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        arcs = np.array([(s, c, t) for s, own in enumerate(nxt) for c, t in own.items()], np.int64).reshape(-1, 3)
        self.source, self.letter, self.target = arcs[:, 0], arcs[:, 1], arcs[:, 2]
        self.states = len(nxt)
        self.bits = float(np.log2(max(2, len(text))))


class Parser:
    """All languages' automata in one hashed table of arcs over one alphabet; arcs of the roots are in ``begin``."""

    def __init__(self, models: list[Automaton]):
        self.bits = np.array([m.bits for m in models])
        self.letters = np.unique(np.concatenate([m.letter for m in models])) if models else np.zeros(0, np.int64)
        self.base = len(self.letters) + 1  # the last number is for letters that no sample has
        self.roots = np.cumsum([0, *[m.states for m in models]])[:-1].astype(np.int64)
        self.begin = np.repeat(self.roots, self.base).reshape(len(models), self.base)  # state after the first letter of a phrase
        keys, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, m in enumerate(models):
            a, first = np.searchsorted(self.letters, m.letter), m.source == 0
            self.begin[k, a[first]] = self.roots[k] + m.target[first]
            keys.append((self.roots[k] + m.source[~first]) * self.base + a[~first])
            to.append(self.roots[k] + m.target[~first])
        self._hash(np.concatenate(keys), np.concatenate(to))
        self._numbers: np.ndarray | None = None

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing; an entry is its key over ``TARGET`` bits of target, so that a look-up touches one place."""
        if len(keys) and (keys.max() >> (62 - TARGET) or to.max() >> TARGET):
            raise ValueError("the samples are too large together: lower chars or rows")
        keys = keys << TARGET
        power = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - power), (1 << power) - 1
        self.table = np.full(1 << power, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.table[slot] < 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[put]] = keys[put] | to[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, to, slot = keys[left], to[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULTIPLIER) >> self.shift).view(np.int64)

    def _step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has an arc with the letter (numbers shifted by ``TARGET``), and where it leads."""
        key = state * (self.base << TARGET)
        key += letter
        slot = self._slot(key)
        got = self.table[slot]
        got ^= key  # a target where the key is the same, less than 0 at a free place
        more = np.flatnonzero(got >> TARGET > 0)
        if len(more):
            flat, keys, slots = got.reshape(-1), key.reshape(-1)[more], slot.reshape(-1)[more]
            while len(more):
                slots = (slots + 1) & self.mask
                own = self.table[slots] ^ keys
                flat[more] = own
                on = own >> TARGET > 0
                more, keys, slots = more[on], keys[on], slots[on]
        return got >= 0, got

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        if self._numbers is None:
            self._numbers = np.full(0x110000, self.base - 1, np.int32)
            self._numbers[self.letters] = np.arange(self.base - 1)
        return self._numbers[codes]

    def phrases(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(language x text) phrases of texts of ``size`` letters that lie one after the other."""
        k, texts = len(self.bits), len(size)
        chunks = np.maximum(1, -(-size // CHUNK))
        owner, head = np.repeat(np.arange(texts), chunks), np.cumsum(chunks) - chunks
        many, nth = len(owner), np.arange(len(owner)) - head[owner]
        length = np.minimum(CHUNK, size[owner] - nth * CHUNK)
        # (place x chunk) letters; what lies beyond a text is letters that no sample has
        lines = np.full(many * CHUNK, self.base - 1, np.int32)
        lines[np.arange(len(letters)) + np.repeat(head * CHUNK - np.cumsum(size) + size, size)] = letters
        grid = np.ascontiguousarray(lines.reshape(many, CHUNK).T)
        starts = np.zeros((CHUNK, k, many), bool)
        state = np.repeat(self.roots, many).reshape(k, many)
        for at, a in enumerate(grid):
            hit, state = self._step(state, a.astype(np.int64) << TARGET)
            new = ~hit
            starts[at] = new
            np.copyto(state, self.begin[:, a], where=new)
        count = starts.sum(axis=0, dtype=np.int64) - (CHUNK - length)
        count, starts, guess = count.reshape(-1), starts.reshape(CHUNK, k * many), state.reshape(-1)
        # follow the phrases that reach into a chunk until one begins where one of the guess does
        language, last, change = np.repeat(np.arange(k), many), guess.copy(), np.zeros(k * many, np.int64)
        tail = np.tile(nth > 0, k)
        todo = np.flatnonzero(tail)
        while len(todo):
            own, change[todo] = self._follow(grid, starts, todo, last[todo - 1], language[todo], length[todo % many])
            own = np.where(own < 0, guess[todo], own)
            changed = own != last[todo]
            last[todo] = own
            todo = todo[changed] + 1
            todo = todo[tail[np.minimum(todo, k * many - 1)] & (todo < k * many)]
        return np.add.reduceat((count + change).reshape(k, many), head, axis=1) if texts else np.zeros((k, 0), np.int64)

    def _follow(self, grid, starts, lane, state, language, length) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's last state (-1 where it met the guess) and how many more phrases it has than the guess up to there."""
        last, change = state.copy(), np.zeros(len(lane), np.int64)
        live = np.arange(len(lane))
        chunk = lane % grid.shape[1]
        for at in range(CHUNK):
            if not len(live):
                break
            a = grid[at, chunk].astype(np.int64)
            hit, state = self._step(state, a << TARGET)
            new = np.flatnonzero(~hit)
            state[new] = self.begin[language[new], a[new]]
            guessed = starts[at, lane]
            change[live] += ~hit
            change[live] -= guessed
            met, over = ~hit & guessed, length == at + 1
            if met.any() or over.any():
                last[live[over]] = state[over]
                last[live[met]] = -1
                on = ~(met | over)
                live, lane, chunk, state, language, length = (x[on] for x in (live, lane, chunk, state, language, length))
        return last, change


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case texts, each run of white space one space, with a space at both ends."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("").cast(pa.string())))
    return pc.binary_join_element_wise("", pc.binary_join(words, " "), "", " ")


def costs(texts: pa.Array, parser: Parser) -> tuple[np.ndarray, np.ndarray]:
    """(language x text) bits, and whether each text has a letter."""
    plain = normalised(texts)
    has = pc.match_substring_regex(plain, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = parser.numbers(np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32))
    count = parser.phrases(letters, size).astype(float)
    stop = np.cumsum(size)
    out = np.zeros_like(count)
    for i, bits in enumerate(parser.bits):
        lacks = parser.begin[i] == parser.roots[i]
        spelt = np.append(0, np.cumsum(lacks[letters]))
        spelt = spelt[stop] - spelt[stop - size]  # each was counted as a phrase
        out[i] = (count[i] - spelt) * bits + spelt * LITERAL
    return out, has


def automata(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> dict[str, Automaton]:
    """Learn from rows with lang and a letter in their text: distinct texts, drawn by a hash, of each language.

    Texts are drawn whole while they have ``chars`` characters together, those that are longer on their own last.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    space = 1_000_003
    labelled = labelled.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(space)))
    # the number of distinct texts sets the share that is drawn; the least draw is in it whatever the estimate says
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return {}
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"], int(space * min(1.0, 2.0 * rows / r["n"]))))])
    drawn = labelled.filter(F.col("draw") <= F.get(F.array(most), F.lit(0))[F.col("lang")])
    drawn = drawn.groupBy("lang", "draw", F.xxhash64("text", F.lit(1)).alias("tie")).agg(F.first("text").alias("text"))
    drawn = drawn.withColumn("size", F.length("text"))
    order = W.partitionBy("lang").orderBy(F.col("size") > chars, "draw", "tie")
    drawn = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    total = F.sum("size").over(W.partitionBy("lang").orderBy("nth"))
    drawn = drawn.withColumn("total", total).filter((F.col("total") <= chars) | (F.col("nth") == 1))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        text = "".join(normalised(table.column("text").combine_chunks()).to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "model": pa.array([pickle.dumps(Automaton(text))], pa.binary())})

    models = drawn.select("lang", "nth", "text").groupBy("lang").applyInArrow(build, "lang string, model binary").collect()
    return {r["lang"]: pickle.loads(r["model"]) for r in sorted(models, key=lambda r: r["lang"])}


def identify(docs: DataFrame, models: dict[str, Automaton], told: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns ``told`` and ``score`` (the runner-up's share of bits against the winner's), without text unless asked for."""
    names = list(models)
    shared = docs.sparkSession.sparkContext.broadcast(Parser(list(models.values())))
    keep = [c for c in docs.columns if c not in (told, score) and (keep_text or c != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        for b in byte_slices(batches, "text", 4 * BATCH // max(4, len(names))):
            if names:
                bits, has = costs(b.column("text"), shared.value)
                best = np.argmin(bits, axis=0)
                two = np.sort(bits, axis=0)[:2]
                share = two[-1] / np.maximum(two[0] + two[-1], 1e-9) if len(names) > 1 else np.ones(b.num_rows)
                said = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist())]
                share = np.where(has, share, 0.0)
            else:
                share, said = np.zeros(b.num_rows), [UNKNOWN] * b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(said, pa.string()), pa.array(share)], [*keep, told, score])

    columns = keep if keep_text else [*keep, "text"]
    return docs.select(*columns).mapInArrow(run, f"{schema}, `{told}` string, `{score}` double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", folded() % 4 == 2)
    models = automata(docs.filter(F.coalesce(~F.col("held_out"), F.lit(False))))
    return identify(docs.drop("lang"), models).select("doc_id", "held_out", "lang_pred", "score")
