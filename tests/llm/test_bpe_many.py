"""Words that fail the pair test are merged together."""

import numpy as np

from popspark.llm import bpe


def test_many_words_are_merged_as_one_by_one(monkeypatch):
    own = bpe.WordBpe(bpe.tokenizer_path())
    rng = np.random.default_rng(4)
    letters = list("aaaaeinstrhlo'!é中\U0001f600")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 3000)] + ["a", "é", "a" * 8, "a" * 9, "th" * 32, "th" * 33, "x" * 300]
    want = [own.exact(w) for w in words]
    assert own.exact_many(words) == want and own.exact_many([]) == []
    # the encoder takes this way where enough words fail, and leaves single merging to longer ones
    long = []
    monkeypatch.setattr(own, "exact", lambda w: long.append(w) or bpe.WordBpe.exact(own, w))
    assert own.encode_words(words) == want and all(len(w.encode()) > bpe.BANDS[-1] for w in long)


def test_a_word_with_a_mark_needs_no_pattern(monkeypatch):
    own = bpe.WordBpe(bpe.tokenizer_path())
    texts = ["éclair, thon. dog' x! 'tis, a1. 1, ... dog's it's, é. ٣, (dog) dog's'"]
    plain = bpe.WordBpe(bpe.tokenizer_path())
    monkeypatch.setattr(bpe, "MARKS", frozenset())
    want = plain.encode(texts)
    monkeypatch.undo()
    seen = []

    class Seen:
        def findall(self, chunk):
            seen.append(chunk)
            return plain.pattern.findall(chunk)

    monkeypatch.setattr(own, "pattern", Seen())
    assert own.encode(texts) == want
    assert set(seen) == {"'tis,", "a1.", "1,", "...", "dog's", "it's,", "٣,", "(dog)", "dog's'"}
