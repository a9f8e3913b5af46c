"""Values of secrets with names of more than one word are seeds."""

import pytest

from tessera.llm import pii

FORMS = [
    'api_key="{}"', 'api_key = "{}"', "api_key: {}", "api-key={}", "apikey={}", "API_KEY = '{}'", 'access_key="{}"', "access_key = {}", "access_key: {}",
    "AWS_SECRET_ACCESS_KEY={}", '"access_key": "{}"', 'token = "{}"', "my_token={}",
]


def test_every_form_is_a_seed(spark):
    values = [f"q{i}w{i:06d}e7r8t9y0" for i in range(len(FORMS))]
    texts = ["set " + f.format(v) + " here" for f, v in zip(FORMS, values, strict=True)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["spans"] for r in pii.extract(docs).collect()}
    assert got == {i: f"id:{t.index(v)}:{t.index(v) + len(v)}" for i, (t, v) in enumerate(zip(texts, values, strict=True))}
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {i: t.replace(v, "[id]") for i, (t, v) in enumerate(zip(texts, values, strict=True))}


@pytest.mark.parametrize("text", ["the monkey = q1w000001e7r8t9y0 here", "keys of the api q1w000001e7r8t9y0 here", "api_key q1w000001e7r8t9y0 here"])
def test_other_words_are_no_seeds(spark, text):
    assert pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] == ""
