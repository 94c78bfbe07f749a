"""Patterns lay out small tables too, not the residual best fit alone."""

import numpy as np

from loomspark.llm import packing


def test_patterns_lay_out_lengths_that_occur_once():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 1001, 400), return_counts=True)
    left = counts.astype(np.int64).copy()
    laid = sum(n for _, n in packing.by_patterns(lengths, left, 1000))
    every = sum(n for _, n in packing.plan(lengths, counts, 1000))
    assert (left >= 0).all() and laid > 0.4 * every
