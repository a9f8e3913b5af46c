"""The search for packings: fillings of any number of items, against brute force."""

import random
from itertools import product

import numpy as np

from tessera.llm import packing


def undominated(counts, room):
    """Fillings in which no item that they lack can stand in for items that are no larger together, in their order."""
    sizes, out = [int(x) for x in np.flatnonzero(counts)], []
    for times in product(*[range(int(counts[x]) + 1) for x in sizes]):
        items = sorted((x for x, k in zip(sizes, times, strict=True) for _ in range(k)), reverse=True)
        waste, absent = room - sum(items), [x for x, k in zip(sizes, times, strict=True) if k < counts[x] and x <= room]
        subsets = [[x for i, x in enumerate(items) if m >> i & 1] for m in range(1 << len(items))]
        if waste >= 0 and not any(x - waste <= sum(s) <= x and s != [x] for s in subsets for x in absent):
            out.append((waste, [-x for x in items]))
    return [[-x for x in items] for _, items in sorted(out)]


def test_fillings_against_brute_force(monkeypatch):
    monkeypatch.setattr(packing, "PATIENCE", 10**9)
    rng = random.Random(1)
    for _ in range(200):
        counts, room = np.bincount([rng.randrange(1, 14) for _ in range(rng.randrange(8))], minlength=31), rng.randrange(1, 31)
        want = undominated(counts, room)
        assert list(packing.fillings(counts, room)) == want
        assert all(list(packing.fillings(counts, room, after=f)) == want[k + 1 :] for k, f in enumerate(want))


def test_impatience_loses_no_filling(monkeypatch):
    counts, room = np.bincount([2, 3, 3, 4, 5, 6, 7, 9], minlength=31), 17
    want = undominated(counts, room)
    monkeypatch.setattr(packing, "PATIENCE", 0)
    assert {tuple(f) for f in want} <= {tuple(f) for f in packing.fillings(counts, room)}


def test_more_than_five_items_a_sequence():
    lengths = [498, 483, 416, 409, 378, 303, 271, 238, 200, 192, 186, 158, 128, 107, 76, 45, 8]
    plan, bound = packing.complete_bins(np.bincount(lengths, minlength=2049), 2048)
    assert bound == 2 == sum(n for n, _ in plan)
    assert sorted((x for n, p in plan for x in p * n), reverse=True) == lengths and all(sum(p) <= 2048 for _, p in plan)


def test_short_pieces_reach_the_bound():
    lengths = np.random.default_rng(8).integers(250, 600, 200)
    plan, bound = packing.complete_bins(np.bincount(lengths, minlength=2049), 2048)
    assert sorted(x for n, p in plan for x in p * n) == sorted(lengths.tolist()) and all(sum(p) <= 2048 for _, p in plan)
    assert sum(n for n, _ in plan) == bound
