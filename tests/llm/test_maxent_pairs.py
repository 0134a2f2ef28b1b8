"""What the language model learns of the two words before a word together."""

import numpy as np

from driftpanel.llm import maxent


def test_pair_of_words_before_is_a_feature():
    # the third word's class is the exclusive or of the two before, so neither alone tells it
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, (2, 60_000))
    classes = [np.full(len(a), 5), np.full(len(a), 6), 2 + (a ^ b)]
    words = [11 + a, 21 + b, 31 + (a ^ b)]
    code = np.stack([c << 24 | w for c, w in zip(classes, words)], 1).astype(np.uint32).ravel()
    mass = np.full(maxent.CLASSES, 1.0)
    mass[:8] = 20_000
    vocab = maxent.Vocabulary(len(code), 6, 0, mass, {}, np.zeros(0, np.int64))
    model = maxent.Model(vocab)
    rows = [len(model.w), len(model.u), maxent.ROWS]
    model.train(code, np.full(len(a), 3), [np.zeros(n, np.float32) for n in rows])
    x = model.classes(tuple(r for r in maxent.features(code, np.full(len(a), 3))[2:-1]))
    p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    assert p[np.arange(2, len(code), 3), classes[2]].mean() > 0.6  # a half at most without the pair


def test_class_sizes():
    assert maxent.HEADS * maxent.MEMBERS == 1024 and maxent.ENDINGS == 32
