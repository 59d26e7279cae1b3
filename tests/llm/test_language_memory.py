"""What a language scorer holds in memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm import language_id


def test_language_scores_hold_few_n_grams_at_once():
    """120,000 unknown words in one text: their n-grams are cut in pieces, with the scores of one piece."""
    rng = np.random.default_rng(1)
    words = list(dict.fromkeys("".join(chr(97 + c) for c in row) for row in rng.integers(26, size=(120_000, 11))))
    keys = [np.zeros(0, np.int64)] * (language_id.LONGEST + 1)
    model = lambda: language_id.Model(["de", "en"], np.array([0.4, 0.6]), keys, [np.zeros((0, 2), np.float32)] * len(keys))
    tracemalloc.start()
    try:
        got = model().score(pa.array([" ".join(words), "", "7"], pa.large_string()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0] == ["en", "und", "und"] and np.allclose(got[1], [0.6, 0, 0])
    assert peak < 80 << 20
