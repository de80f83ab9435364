"""Corpus operators read whole texts, in training too."""

import numpy as np
import pyarrow as pa

from popspark.llm import language_id, quality
from popspark.llm.common import Words


def test_quality_trains_on_whole_texts(spark, monkeypatch):
    prose = "The river runs down to the sea and the old road follows it. " * 80
    rows = [(i, prose + "#$% | {} ~ ^^ " * 600 + str(i)) for i in range(8)] + [(100 + i, prose + str(i)) for i in range(8)]
    seen = {}

    real = quality.Scorer.__init__

    def spy(self, x, doc, feature, share, target):
        seen.update(x=x, doc=doc, feature=feature, share=share, target=target)
        real(self, x, doc, feature, share, target)

    monkeypatch.setattr(quality.Scorer, "__init__", spy)
    monkeypatch.setattr(quality, "weak_labels", lambda patterns, counts: patterns / 10_000)
    quality.classify(spark.createDataFrame(rows, "doc_id long, text string"))
    w = Words(pa.array([t for _, t in rows]))
    x = quality.features(w)
    assert 0 < len(seen["x"]) and {tuple(r) for r in seen["x"].tolist()} <= {tuple(r) for r in x.tolist()}
    junk = seen["x"][:, 0] > 0.06  # only beyond 4000 characters
    assert junk.any() and set(seen["target"].tolist()) <= set((quality.pattern_of(quality.votes(x)) / 10_000).tolist())
    assert np.allclose(np.bincount(seen["doc"], weights=seen["share"]), 1)


def test_blank_and_tiny_samples_do_not_win(spark):
    english = ["the old road follows the river down to the sea", "rivers and roads lead from the hills to the town"]
    rows = [(i, english[i % 2] + f" {i}", "en") for i in range(40)] + [(100, "  ", "blank"), (101, "", "blank"), (102, "12 34", "digits"), (103, "q", "tiny")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.automata(d)
    assert sorted(models) == ["en", "tiny"]
    # an automaton without letters must not win even where it is given
    models["blank"] = language_id.Automaton("  ")
    got = language_id.identify(d.filter("lang = 'en'").drop("lang"), models).toPandas()
    assert set(got.lang_pred) == {"en"}


def test_letters_outside_a_sample_cost_the_same_everywhere():
    small, large = language_id.Automaton(" ab "), language_id.Automaton(" " + "ab cd " * 500)
    costs, _ = language_id.costs(pa.array(["\u0416", "\u0416\u0416\u0416"]), language_id.Parser([small, large]))
    assert np.allclose(costs[:, 1] - costs[:, 0], 2 * language_id.LITERAL)
