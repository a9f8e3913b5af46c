"""All license rules against a plain version: what each matches is found, and overlaps are resolved by priority first."""

import random
import re

from tessera.llm import licenses
from test_license_gate import matches


def plain(text, rules):
    norm = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    found = []
    for i, r in enumerate(rules):
        if r.keyword in norm:
            for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", norm):
                if m[0]:
                    a = norm[: m.start()].count(" ")
                    b = a + m[0].count(" ") + 1
                    found.append((r.priority, a - b, a, i, b, r.label))
    kept = []
    for p, _, a, _, b, label in sorted(found):
        if not any(k[0] < b and a < k[1] and (k[2] < p or (k[0] <= a and b <= k[1])) for k in kept):
            kept.append((a, b, p, label))
    base = {label for phrase, label in licenses.BASE.items() if re.search(rf"(?<![^ ]){phrase}(?![^ ])", norm)}
    return ",".join(sorted(base | {k[3] for k in kept}))


def test_labels_against_a_plain_version(spark):
    rules = licenses.rules()
    assert len(licenses.NOTICES) + len(licenses.NAMES) + len(licenses.SINGLES) + sum(len(f[2]) for f in licenses.FAMILIES) > 200
    rng, texts = random.Random(1), []
    for r in rules:
        options = [t for t in matches(r.pattern) if re.fullmatch(r.pattern, t)]
        assert options and all(r.keyword in t for t in options), r
        texts.append(f"It says: {rng.choice(options)}.")
    texts += [" ".join(rng.choice(texts) for _ in range(4)) for _ in range(200)] + ["cc by sa 4 0 or later gnu gpl v3 only mit license apache license version 2.0", ""]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t, rules), t
    for r, i in zip(rules, range(len(rules)), strict=False):
        assert got[i], texts[i]
