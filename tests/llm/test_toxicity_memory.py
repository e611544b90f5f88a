"""The toxicity fit runs in the driver: what it holds is bounded by the training pairs, and how it is cut changes no result."""

from __future__ import annotations

import tracemalloc

import numpy as np

from typeloom.llm import toxicity


def _texts(n: int) -> tuple[list[str], list[int]]:
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in ("brak", "stil", "monde", "ürte") for b in ("wend", "losk", "vier") for c in ("an", "ung", "eth")]
    labels = [int(i % 7 == 0) for i in range(n)]
    texts = [". ".join(" ".join(rng.choice(words, 9)) + (" vilefoul" if y and k == 1 else "") for k in range(4)) for y in labels]
    return [*texts, ""], [*labels, 0]


def test_fit_holds_no_long_copies():
    texts, labels = _texts(4000)
    tracemalloc.start()
    model = toxicity.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(model.weights) > 0
    assert peak < 64 << 20


def test_fit_does_not_depend_on_its_ranges(monkeypatch):
    texts, labels = _texts(300)
    whole = toxicity.fit(texts, labels)
    for letters, pairs in ((1, 1), (1000, 7), (1 << 30, 1 << 30)):
        monkeypatch.setattr(toxicity, "FIT_LETTERS", letters)
        monkeypatch.setattr(toxicity, "FIT_PAIRS", pairs)
        cut = toxicity.fit(texts, labels)
        assert (cut.weights == whole.weights).all() and (cut.bias, cut.leak) == (whole.bias, whole.leak)
