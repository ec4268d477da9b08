"""Shingles of chunks with few words in total."""

import pytest

from lastrum.llm.words import shingles


@pytest.mark.parametrize("width", (3, 5))
def test_chunks_of_few_words(width):
    for total in range(width + 2):
        text = " ".join(f"w{i}" for i in range(total)).encode()
        wanted = min(total, 1) if total < width else total - width + 1
        alone, offsets = shingles([text], width)
        assert len(alone) == wanted and list(offsets) == [0, wanted]
        found, offsets = shingles([b"", text, b" "], width)
        assert list(found) == list(alone) and list(offsets) == [0, 0, wanted, wanted]
        # a text has the same shingles in a chunk with others
        assert list(shingles([text, b"many other words are in this chunk too"], width)[0][:wanted]) == list(alone)
    assert len(shingles([], width)[0]) == 0
