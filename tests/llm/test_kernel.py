"""Words and shingles as hashes."""

import numpy as np


def test_word_hashes_tell_words_apart():
    from corvane.llm.kernel import shingle_hashes, text_buffer, word_hashes, word_spans
    import pyarrow as pa

    column = pa.array(["Ab c d  ab", None, "", "x", "ab c d e f g"])
    data, offsets = text_buffer(column)
    starts, ends, bounds = word_spans(data, offsets)
    assert np.diff(bounds).tolist() == [3, 0, 0, 1, 6]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 8
    s, owner = shingle_hashes(h, bounds, 5)
    assert owner.tolist() == [0, 3, 4, 4] and len(set(s.tolist())) == 4
