"""Line rules at word bounds, by share of a line's words, and with the sentence marks of several scripts."""

import duckdb
import pytest

from tessera.llm import quality
from tessera.llm.oracles import QUALITY

LINES = [
    ("All rights reserved.", True),
    ("READ MORE | Privacy policy", True),
    ("the oneshare onealy of them", False),
    ("they share one and spread more here", False),
    ("éclick here", False),
    ("we mailed the newsletter to all who asked for it last week after the fair ended", False),
    ("read more about it in our newsletter and sign up for the next one that we write in may", True),
    ("word " * 61, True),
    ("word " * 61 + "end.", False),
    ("शब्द " * 61 + "है।", False),
    ("كلمة " * 61 + "هل؟", False),
    ("", False),
]


def test_each_line_is_judged_as_meant(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i long, x string")
    got = {r["i"]: r["bad"] for r in rows.select("i", quality.line_fails(rows["x"]).alias("bad")).collect()}
    assert got == {i: bad for i, (_, bad) in enumerate(LINES)}


@pytest.mark.parametrize("sep", ["\n", " "])
def test_sql_agrees_on_these_lines(spark, tmp_path, sep):
    good = "A fine first sentence stands here today and holds more than twenty words, so that the rest of it alone may decide what happens to it."
    docs = [(i, sep.join([good, x])) for i, (x, _) in enumerate(LINES)] + [(100, None), (101, ""), (102, sep.join(x for x, _ in LINES))]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left"]
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = db.sql(f"select {', '.join(names)} from ({QUALITY})").fetchall()
    assert sorted(map(tuple, quality.query(spark, str(tmp_path)).select(names).collect())) == sorted(want)
