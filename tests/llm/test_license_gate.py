"""Every text that a license rule matches passes the gate."""

import re
from itertools import product
from re import _constants as c
from re import _parser

from pyspark.sql import functions as F

from tessera.llm import licenses


def matches(pattern):
    """Texts that a rule's pattern matches: each choice, each optional part with and without."""

    def of(part):
        op, value = part
        if op is c.LITERAL:
            return [chr(value)]
        if op is c.IN:
            return [chr(v) if o is c.LITERAL else chr(v[0]) for o, v in value]
        if op is c.ANY:
            return ["x"]
        if op is c.SUBPATTERN:
            return every(value[3])
        if op is c.BRANCH:
            return [t for branch in value[1] for t in every(branch)]
        assert op is c.MAX_REPEAT
        some = [x * max(1, value[0]) for x in every(value[2])]
        return ["", *some] if value[0] == 0 else some

    def every(parts):
        return ["".join(x) for x in product(*map(of, parts))]

    return every(_parser.parse(pattern))


def test_every_rule_passes_the_gate(spark):
    rules = licenses.rules()
    texts = {t for r in rules for t in matches(r.pattern) if re.fullmatch(r.pattern, t)}
    assert len(texts) > len({r.pattern for r in rules})
    for sep in (" ", "-\n"):
        df = spark.createDataFrame([(f"x {t.replace(' ', sep)}.",) for t in texts], "text string")
        assert [r["text"] for r in df.filter(~F.col("text").rlike(licenses._gate(rules))).collect()] == []


def test_mit_without_the_word_license(spark):
    texts = ["Released under MIT.", "available under the terms of MIT", "Distributed under the\nterms of the MIT", "sent under mitigation"]
    got = {r["doc_id"]: (r["labels"], r["score"] > 0) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", True), 1: ("mit", True), 2: ("mit", True), 3: ("", False)}
