"""Columns of the input whose names the operators might use themselves stay as they are."""

import random

import pytest

from tessera.llm import ngram_join, packing, pii, quality, substrings

NAMES = ["__id", "__hash", "__spans", "__ordered", "__text", "__none", "n", "low", "len", "high", "base", "size", "salt", "row", "hit", "new", "spans", "first_id", "no_text", "cols", "rest", "part", "at", "body", "kept", "carried"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [passage + " mail a@b.org.", passage + " mail a@b.org, too.", passage, "Other words. " + " ".join(f"v{i}" for i in range(30)), None, ""]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(i, t, len(t or ""), *[f"{c}{i}" for c in NAMES]) for i, t in enumerate(texts)], schema)


@pytest.mark.parametrize("stage", [pii.redact, ngram_join.keep_one, substrings.drop_repeats, quality.keep_clean], ids=lambda f: f.__name__)
def test_documents(docs, stage):
    out = stage(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_stages_without_other_columns(docs):
    slim = docs.select("doc_id", "text")
    for stage in (pii.redact, ngram_join.keep_one, substrings.drop_repeats, quality.keep_clean):
        assert stage(slim).columns == ["doc_id", "text"] and stage(slim).count()


def test_pieces(docs):
    pieces = packing.tokenize(docs).join(docs.select("doc_id", *NAMES), "doc_id")
    out = packing.pack(pieces)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in NAMES)
    again = packing.pack(out)
    assert again.columns == out.columns and again.count() == out.count()
