"""The join's memory: pairs and heads a slice at a time, and freed memory goes back to the system after each task."""

import tracemalloc
from functools import partial

import numpy as np
import psutil
import pyarrow as pa
import zstandard

from tessera.llm import common, ngram_join


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_pairs_of_long_sets_take_little_memory():
    sets = [np.arange(i % 2, 8000 + i % 2, dtype=np.uint64) << np.uint64(20) for i in range(120)]
    doc, zero = np.arange(120), np.zeros(120, np.int64)
    given = [ngram_join.bitmap(s) for s in sets]
    (a, b, short), mb = peak_mb(lambda: ngram_join.tile_pairs(doc, np.full(120, 8000), doc, zero.astype(bool), zero, given, 80, None))
    assert (len(a), len(set(zip(a.tolist(), b.tolist(), strict=True))), short) == (120 * 119 // 2, 120 * 119 // 2, False)
    assert mb < 16


def test_heads_are_held_one_at_a_time(monkeypatch):
    monkeypatch.setattr(ngram_join, "_sets_of", partial(ngram_join._sets_of, most_bytes=100_000))
    body = lambda *words: zstandard.ZstdCompressor().compress(" ".join(words).encode())
    like = [body(*[f"{i}w{k}" for k in range(2000)]) for i in range(400)]
    pairs = [(i, j) for i in range(400) for j in ((i, (i + 1) % 400) if i % 3 else (i,))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([j for _, j in pairs], pa.int64()), pa.array([like[i] for i, _ in pairs], pa.binary()), pa.array([like[j] for _, j in pairs], pa.binary())], names=["a", "b", "x", "y"])
    rows = lambda: [(r["a"], r["b"]) for out in ngram_join._linked(iter([batch]), 80, 5) for r in out.to_pylist()]
    every, _ = peak_mb(lambda: len(list(ngram_join._sets_of(like, 5))))
    got, mb = peak_mb(rows)
    assert (every, got) == (400, [(i, i) for i in range(400)])
    sizes = sum(len(b) for i, j in pairs for b in (like[i], like[j])) / 1e6
    assert mb < sizes + 4


def test_freed_memory_goes_back_after_a_task():
    """Freed blocks below one that stays would be kept by the allocator."""
    own = lambda: psutil.Process().memory_info().rss / 1e6
    stays = []

    def run(batches):
        blocks = [np.ones(12_000) for _ in range(2000)]
        stays.append([np.ones(12_000) for _ in range(5)])
        yield from batches
        assert len(blocks) == 2000

    before = own()
    assert list(common.giving_back(run)([1])) == [1]
    assert own() - before < 60
