"""Rows without a doc_id keep their text, their links and one document of each group."""

import random

from tessera.llm import ngram_join

SCHEMA = "doc_id long, text string, source string"


def test_null_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    # The first row of the one chunk is nameless and holds the body of 5's class, which 3 is a near copy of.
    rows = [(None, a, "1"), (5, a, "2"), (3, near(a), "3"), (None, b, "4"), (None, near(b), "5"), (None, b, "6"), (None, c, "7"), (None, None, "8"), (None, "", "9"), (9, text(), "10")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()), key=str)
    want = [(None, 56, 3), (5, 56, 3), (3, 56, 3), *[(None, 56, None)] * 4, *[(None, 0, None)] * 2, (9, 56, 9)]
    assert got == sorted(want, key=str)
    kept = ngram_join.keep_one(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    out = {r["source"]: (r["doc_id"], r["text"]) for r in kept.collect()}
    assert len(out) == kept.count() and len(out.keys() & {"4", "5", "6"}) == 1
    assert {k: v for k, v in out.items() if k not in "456"} == {s: (i, t) for i, t, s in rows if s in ("3", "7", "8", "9", "10")}


def test_null_ids_beside_the_largest_id(spark):
    top = 2**63 - 4
    df = spark.createDataFrame([(top, "x y", "1"), (None, "a b", "2"), (None, "c d", "3"), (None, "x y", "4")], SCHEMA).repartition(3)
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(df).collect()) == ["9223372036854775804", "None", "None"]
