import random

import brute
import numpy as np

from tessera.llm import ngram_join


def test_a_tile_tells_whether_it_withheld_pairs():
    sets = [np.arange(100, dtype=np.uint64) << np.uint64(20)] * 5
    doc, n, comp = np.arange(5), np.full(5, 100), np.array([9, 9, 9, 9, 4])
    side = np.array([2, 2, 2, 2, 0])
    for likeliest, pairs, withheld in ((2, 2, True), (4, 4, False), (None, 4, False)):
        a, b, short = ngram_join.tile_pairs(doc, n, comp, np.zeros(5, bool), side, [ngram_join.bitmap(s) for s in sets], 80, likeliest)
        assert (len(a), len(b), short) == (pairs, pairs, withheld)


def test_withheld_pairs_are_tried_later(spark, monkeypatch):
    """With no likeliest pairs at all, the links that hubs miss come of the second round alone."""
    rounds, found = [], []
    open_pairs, verify = ngram_join.open_pairs, ngram_join.verify
    monkeypatch.setattr(ngram_join, "LIKELIEST", 0)
    monkeypatch.setattr(ngram_join, "open_pairs", lambda *a: rounds.append(a[-1]) or open_pairs(*a))
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, *a: found.append(pairs.count()) or verify(pairs, *a))
    rng = random.Random(9)
    docs = []
    for i in range(24):
        w = [f"b{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.randrange(1, 4)):
            w[k] = f"n{rng.random()}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=4).collect()}
    want = brute.components(docs)
    assert len({c for _, c in want.values()}) < len(docs)
    assert got == want
    assert rounds == [0, None]
    assert len(found) == 2 and found[1] > 0
