"""Each softmax of the language model sees three words back."""

import numpy as np
import pytest

from loomspark.llm import lm


@pytest.mark.parametrize("back", [1, 2, 3])
@pytest.mark.parametrize("part", ["class", "subclass"])
def test_lm_learns_from_each_word_back(back, part):
    # the cell is set by the word ``back`` places before, all words else are at random
    rng, n = np.random.default_rng(back), 60000
    word = rng.integers(0, 2, n)
    told = np.roll(word, back)
    cell = lm.CLASSES * told if part == "class" else told
    h = np.array([0x1234567 << 32, 0x7654321 << 32], np.uint64)[word]
    start, m = np.array([0]), lm.fresh_model()
    lm.learn(m, h, cell, start)
    assert lm.class_scores(m, h, cell, start)[-8192:].mean() > -0.2  # about -0.4 where that word is not seen
