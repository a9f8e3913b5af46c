"""The word cache keeps the words that come again when it is full, and gives the ids of a cache without limit."""

import numpy as np

from tessera.llm import packing


def test_words_that_come_again_are_encoded_once(monkeypatch):
    learned = []
    learn = packing.WordCache.learn
    monkeypatch.setattr(packing.WordCache, "learn", lambda self, words: learned.extend(words) or learn(self, words))
    path, common = packing.tokenizer_path(), [b"the", b"of", b"stra\xc3\x9fe", b"x7y", b"unbelievably"]
    batches = [common + [f"w{k}odd{i}".encode() for i in range(20)] for k in range(12)]
    small, whole = packing.WordCache(path, 40), packing.WordCache(path, 10**9)
    out = [small.encode(b) for b in batches]
    assert [learned.count(w) for w in common] == [1] * len(common)
    assert len(small.index) <= 40 + 25
    for (ids, sizes), b in zip(out, batches, strict=True):
        want = whole.encode(b)
        assert np.array_equal(ids, want[0]) and np.array_equal(sizes, want[1])


def test_a_cache_full_of_common_words_is_emptied():
    cache = packing.WordCache(packing.tokenizer_path(), 10)
    words = [f"c{i}".encode() for i in range(30)]
    first = cache.encode(words)
    for _ in range(3):
        again = cache.encode(words)
        assert len(cache.index) == 30 and np.array_equal(first[0], again[0]) and np.array_equal(first[1], again[1])
