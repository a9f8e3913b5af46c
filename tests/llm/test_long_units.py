"""N-best segmentation: whole texts against brute force, and units of any length."""

import random
import zlib
from itertools import product

import numpy as np

from tessera.llm import nbest


def all_segmentations(model, unit):
    edges = model.edges(unit)

    def of(end):
        return [(0, [])] if end == 0 else [(g + s, [*path, e]) for i, e, s in edges[end] for g, path in of(i)]

    # best first; ties by the last differing edge
    return sorted(of(len(unit)), key=lambda x: (-x[0], x[1][::-1]))


def test_texts_against_brute_force():
    model, rng = nbest.Model(nbest.model_path()), random.Random(4)
    encoder = nbest.Encoder(nbest.model_path(), 4)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abeinst") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4)))
        units = [all_segmentations(model, u) for u in nbest._UNITS.findall(" " + text)]
        every = [(sum(x[0] for x in pick), [i for x in pick for e in x[1] for i in model.spell(e)]) for pick in product(*[u[:4] for u in units])]
        got = encoder.encode([text])[0]
        assert [s for s, _ in got] == sorted((s for s, _ in every), reverse=True)[:4]
        known = {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for s, ids in every}
        assert {(s, zlib.crc32(ids.astype("<u4").tobytes())) for s, ids in got} <= known and len({i.tobytes() for _, i in got}) == len(got)


def test_units_against_brute_force():
    model, rng = nbest.Model(nbest.model_path()), random.Random(6)
    for alphabet in ("a", "ab", "estin "):
        for length in range(1, 13):
            unit = "".join(rng.choice(alphabet) for _ in range(length)).strip() or "a"
            best = all_segmentations(model, unit)
            for n in (1, 2, 5):
                assert model.search(unit, n) == best[:n]
            path, score, second = model.score_one(unit)
            assert (score, path) == best[0] and second == (best[1][0] if len(best) > 1 else nbest._NONE)


def test_texts_without_spaces(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(60_000)), "a" * 60_000, "語" * 30_000]
    out = nbest.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert all(r["round_trip"] and len(r["nbest_scores"]) == 4 and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) for r in out if r["doc_id"] < 2)
    assert all(r["round_trip"] for r in out)
