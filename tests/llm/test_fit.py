"""The fit of a budget where all lengths left are very long."""

import numpy as np

from siltstone.llm import mixing


def test_one_very_long_document_fills_the_gap():
    length, count = np.array([990_000, 1_200_000]), np.array([1, 1])
    assert mixing.fit(length, count, 1_000_000).tolist() == [1, 0]
