"""Tiles of one hub: members that share many rare shingles meet once, not once a shingle."""

import random

import brute

from tessera.llm import ngram_join

REPS = "rep long, n long, own long, prefix array<long>"


def members(spark, reps):
    out = {}
    for r in ngram_join._tiles(spark.createDataFrame(reps, REPS), 80).collect():
        out.setdefault((r["token"], r["tile"]), []).append((r["rep"], r["hub"], r["guest"]))
    return sorted(sorted(x) for x in out.values())


def test_overlapping_tiles_of_one_hub_are_one(spark):
    reps = [(0, 100, 0, [1, 2, 3])] + [(i, 100, 5, [k for k in (1, 2, 3) if k != 1 + i % 3]) for i in range(1, 11)]
    assert members(spark, reps) == [[(i, 0, False) for i in range(11)]]


def test_tiles_that_share_little_but_their_hub_stay_apart(spark):
    reps = [(0, 100, 0, [1, 2])] + [(i, 100, 5, [1 + i % 2]) for i in range(1, 11)]
    assert members(spark, reps) == [[(i, 0, False) for i in (0, *range(k, 11, 2))] for k in (1, 2)]


def test_a_group_of_many_shared_shingles_meets_in_few_rows(spark, monkeypatch):
    """Sets little above and below the threshold share dozens of rare shingles; each is a tile of nearly the same members."""
    rows, tiles = [], ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda *a: rows.append(out := tiles(*a)) or out)
    monkeypatch.setattr(ngram_join, "discard", lambda *a: None)
    rng = random.Random(4)
    docs = []
    for i in range(60):
        w = [f"b{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.randrange(1, 4)):
            w[k] = f"n{rng.random()}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block_rows=8).collect()}
    want = brute.components(docs)
    assert 1 < len({c for _, c in want.values()}) < len(docs)
    assert got == want
    assert rows[0].count() <= 4 * len(docs)
