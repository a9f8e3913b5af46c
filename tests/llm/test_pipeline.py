"""The pipeline against a brute-force version of its stages, on planted cases."""

import random

import numpy as np

import brute
import corpus_pipeline
from tessera.llm import packing
from test_texts import check_packing


def documents():
    rng = random.Random(11)
    vocab = [format(i, "b").replace("0", "ka").replace("1", "re") for i in range(3, 300)]
    sentence = lambda n: (" ".join(rng.choices(vocab, k=n))).capitalize() + "."
    passage = sentence(60)
    docs = [(i, "\n".join(sentence(25) for _ in range(4))) for i in range(12)]
    near = docs[3][1].split(" ")
    near[50] = "other"
    docs += [(20, docs[2][1]), (21, " ".join(near)), (22, sentence(30) + " " + passage), (23, passage + "\n" + sentence(40))]
    docs += [(24, sentence(30) + " write to some.one@mail.example.com or 10.0.0.1 now, " + sentence(20)), (25, "short"), (26, None), (27, "again and again we go there " * 20), (28, "A | B | C | D\n" * 10)]
    return docs


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = documents()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    clean = [d for d in docs if d[0] not in (25, 26, 27, 28)]
    comps = brute.components(clean)
    single = [(i, t) for i, t in clean if comps[i][1] == i]
    assert {i for i, _ in clean} - {i for i, _ in single} == {20, 21}
    cut = brute.without_repeats(single)
    assert cut[23][1] == 60 and sum(n for _, n, _ in cut.values()) == 60
    final = []
    for i, t in single:
        text = cut[i][2] if cut[i][1] else t
        for kind, a, b in sorted(brute.personal(text), key=lambda s: -s[1]):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        final.append((i, text))
    assert "[email] or [ip] now" in dict(final)[24]

    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == df.columns
    got = stage.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(final)
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cache = packing.WordCache(packing.tokenizer_path())
    want = {i: len(cache.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in final}
    assert {r["doc_id"]: r["length"] for r in packed} == want
    check_packing(packed)
    counts = np.bincount(list(want.values()), minlength=2049)
    assert len({r["sequence_id"] for r in packed}) <= packing.lower_bound(counts, 2048) + 1
