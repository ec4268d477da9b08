"""The shape of a word is that of the whole word."""

import numpy as np

from lastrum.llm import quality


def test_shape_reads_the_whole_word():
    assert quality._shape("a1" * 40 + "+B") == "a0" * 40 + "+A"
    of = quality.featurise()
    shape = lambda word: set(of(word)[0].tolist())
    same, other = shape("ab12" * 20 + "zz"), shape("ab12" * 20 + "//")
    assert len(same & shape("cd34" * 20 + "yy")) > len(other & shape("cd34" * 20 + "yy"))
    assert np.isfinite(of("x1" * 50_000)[1]).all()
