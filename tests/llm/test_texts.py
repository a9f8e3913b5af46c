"""Substring dedup, n-gram join, quality, licenses, personal data, sharding, language and packing against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

import brute
from tessera.llm import langid, licenses, nbest, ngram_join, packing, pii, quality, sharding, substrings
from tessera.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, chunk int, row string, words int, h string"


def corpus():
    """Copies, near copies, a passage that many share, nulls, empty, long and odd texts."""
    rng = random.Random(5)
    vocab = ["w" + format(i, "x") + "é" * (i % 7 == 0) for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    out, base = [], " ".join(rng.choices(vocab, k=120))
    for i in range(40):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = rng.choice(vocab).upper()
        out.append(" ".join(w))
    out += [base, base.upper(), base.replace(" ", "\n\t")]
    out += [" ".join(rng.choices(vocab, k=30)) + " " + passage + " " + " ".join(rng.choices(vocab, k=30)) for _ in range(15)]
    out += [None, "", " \n ", "one", "one", "two words", "a b c d e", "a b c d e", "x " * 3000, "y" * 50_000, " ".join(rng.choices(vocab, k=5000))]
    out += [" ".join(rng.choices(vocab, k=rng.randrange(1, 40))) for _ in range(20)]
    ids = list(range(100, 100 + len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out, strict=True))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, None, len(t or ""), "clash", 1, None, None, "h") for i, t in docs], SCHEMA).repartition(5)


def test_substrings_against_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: r for r in substrings.repeats(frame(spark, docs), part_bytes=4000).collect()}
    for i, (n, removed, kept) in brute.without_repeats(docs).items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"], got[i]["kept_sha256"]) == (n, removed, kept, brute.digest(kept))
    assert substrings.repeats(frame(spark, docs[:1]).limit(0)).count() == 0
    twice = frame(spark, [(1, "a " * 20), (1, "a " * 20), (None, "a " * 20)])
    assert {(r["doc_id"], r["n_removed"]) for r in substrings.repeats(twice).collect()} == {(1, 0), (None, 20)}


@pytest.mark.parametrize("window", [2, 5, 8])
def test_other_windows(spark, window):
    docs = corpus()[:30]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.repeats(frame(spark, docs), window=window, part_bytes=2000).collect()}
    assert got == {i: x[1] for i, x in brute.without_repeats(docs, window).items()}


def test_doubling_ends_without_survivors(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "p " + text), (3, " ".join(text.split()[:13])), (4, "other words")], "doc_id long, text string")
    assert {r["doc_id"]: r["longest"] for r in substrings.longest_repeats(docs).collect()} == {2: 26, 3: 13}


def test_ngram_join_against_brute_force(spark):
    docs = corpus()
    for block_rows in (3, 512):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, docs), part_bytes=4000, block_rows=block_rows).collect()}
        assert got == brute.components(docs)
    assert ngram_join.join(frame(spark, docs[:1]).limit(0)).count() == 0


def test_copies_without_their_original(spark):
    """Copies that all differ: no hub links them all, so tiles must find every link."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(24):
        w = list(base)
        for k in rng.sample(range(100), rng.randrange(1, 4)):
            w[k] = f"n{rng.random()}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, docs), block_rows=4).collect()}
    assert got == brute.components(docs)


def test_bitmaps_bound_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(5, 200))) for _ in range(2))
        words = min(len(ngram_join.bitmap(a)), len(ngram_join.bitmap(b)))
        x, y = ngram_join.fold(ngram_join.bitmap(a), words), ngram_join.fold(ngram_join.bitmap(b), words)
        bound = min(len(a) - np.bitwise_count(x & ~y).sum(), len(b) - np.bitwise_count(y & ~x).sum())
        assert len(np.intersect1d(a, b)) <= bound


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | {100: 100, 101: 100}


def test_quality_against_brute_force(spark):
    docs = [*corpus(), (1, "say it again now my old friend ok " * 9), (2, "Good line here.\n" * 6), (3, "A | B | C | D\n" * 8), (4, "A fine first sentence stands here today.\nHome | About | Help | Contact\n" + "More of the good text follows in this line, and it says other things. The last of them is that rain fell over the hills.")]
    got = {r["doc_id"]: r for r in quality.assess(frame(spark, docs)).collect()}
    for i, t in docs:
        r = got[i]
        want = brute.quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    assert not got[3]["kept"] and got[4]["kept"] and "Home" not in got[4]["clean_text"]
    kept = quality.keep_clean(frame(spark, docs))
    assert kept.columns == frame(spark, docs[:1]).columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality.assess(frame(spark, docs[:1]).limit(0)).count() == 0


def test_licenses_against_brute_force(spark):
    assert len(licenses.rules()) > 300
    texts = ["MIT License mit licensE. CC BY cc by-sa 4.0 GNU General Public License version 2.0 or later, cc\nby", "", None, "mité license MIT-LICENSE xmit license", "Licensed under the Apache License, Version 2.0.", "cc by cc by", "plain"]
    df = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[0]["labels"] == "cc-by,cc-by-sa-4.0,gpl,gpl-2.0-or-later,mit" and got[4]["labels"] == "apache,apache-2.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_personal_data_against_brute_force(spark):
    texts = [
        "a@b.c_d@e.f x@y foo@bar.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 4111 1111 1111 1111-2", "+1 (2) 3 +123456789 é+44 20 7946 0958x 4111-1111-1111-1111", None, "", "a" * 20_000 + "@", "1" * 20_000, "1." * 5000,
        'set token = "abcdef0123456789" here', "user number aa4111111111 x",
    ]
    docs = list(enumerate(texts)) + [(900 + i, f"account holder id: K{i}X{i:06d}Z says password=Q{i}W{i:06d}E now") for i in range(5)]
    df = frame(spark, docs)
    got = {r["doc_id"]: r for r in pii.extract(df).collect()}
    for i, t in docs:
        want = brute.personal(t)
        assert got[i]["base_sha256"] == brute.digest(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(got[i]["spans"].split(",")) | {""}
    assert "id:13:29" in got[8]["spans"] and "id:" not in got[9]["spans"]
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[0] == "[email][email] x@y [email]."
    assert pii.extract(df.limit(0)).count() == 0


def test_confident_contexts_find_new_identifiers(spark):
    seeds = [(i, f"please write contact reference number: user{i}@mail.example.com today") for i in range(6)]
    news = [(50, "please write contact reference number: ZX81-44A77Q today"), (51, "some code in the text: ZX81-44A77Q today")]
    got = {r["doc_id"]: r["spans"] for r in pii.extract(spark.createDataFrame(seeds + news, "doc_id long, text string")).collect()}
    assert got[50] == "id:39:50" and got[51] == ""


def test_sharding(spark):
    docs = [*corpus(), (None, "n"), (None, "m")]
    df = frame(spark, docs)
    out = sharding.shuffle_into_shards(df, 8, bucket_bytes=4000).collect()
    per = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)}
    assert sum(map(len, per.values())) == len(docs) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(v == list(range(len(v))) for v in per.values())
    assert sorted(str(r["record"]["doc_id"]) for r in out) == sorted(str(i) for i, _ in docs)
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0
    q = sharding.query(spark, SF).collect()
    assert len(q) == 200 and {r["law"] for r in q} == {"rows"}


def test_sharding_is_one_order_a_seed(spark):
    """Whatever the partitioning: ids and whole records that many rows share included."""
    rows = [(i, t) for i, t in corpus()] + [(7, "copy")] * 5000 + [(7, f"same id {i}") for i in range(300)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = lambda d, seed=1: sorted((str(r["record"]["doc_id"]), str(r["record"]["text"]), r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(d, bucket_bytes=20_000, seed=seed).collect())
    one = placed(df.repartition(3))
    assert one == placed(df.repartition(7, "text")) and one != placed(df, seed=2)
    assert sorted((a, b) for a, b, _, _ in one) == sorted((str(i), str(t)) for i, t in rows)
    copies = [slot * 8 + shard for _, t, shard, slot in one if t == "copy"]
    assert 0.4 < sum(copies) / len(copies) / len(rows) < 0.6  # not together


def test_shards_are_written(spark, tmp_path):
    sharding.write_shards(frame(spark, corpus()).select("doc_id", "text"), str(tmp_path / "out"), shards=3, bucket_bytes=4000)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_nbest_against_brute_force():
    m = nbest.Model(nbest.model_path())

    def every(unit):
        edges, out = m.edges(unit), []

        def go(at, path, score):
            if not at:
                out.append((-score, tuple(path)))
            for i, e, s in edges[at]:
                go(i, [*path, e], score + s)

        go(len(unit), [], 0)
        return sorted(out)

    for unit in (" the", " world", "  a", "\n", "ñaé", " erth", "☃x", "   ", " thanon"):
        best = every(unit)
        assert [(-s, list(p[::-1])) for s, p in best[:4]] == m.search(unit, 4)
        units, ids, sizes, score, second = m.score_units([unit])
        assert units == [unit] and ids.tolist() == [i for e in best[0][1][::-1] for i in m.spell(e)] and sizes.sum() == len(ids)
        assert score[0] == -best[0][0] and second[0] == (-best[1][0] if len(best) > 1 else nbest._NONE)


def test_nbest_operator(spark):
    docs = [(1, "the the a\nb"), (2, None), (3, ""), (4, " lead  two"), (5, "é☃" * 40), (6, "x" * 3000), (7, "word " * 4000)]
    out = nbest.encode(frame(spark, docs), with_ids=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["round_trip"] for r in got.values())
    assert got[2]["n_pieces"] == 0 and len(got[2]["nbest_scores"]) == 1
    assert all(list(r["nbest_scores"]) == sorted(r["nbest_scores"], reverse=True) and len(set(zip(r["nbest_scores"], r["nbest_ids_crc32"], strict=True))) == len(r["nbest_scores"]) for r in got.values())
    assert {r["doc_id"]: r["text"] for r in nbest.decode(out).collect()} == {i: t or "" for i, t in docs}
    assert nbest.encode(frame(spark, docs[:1]).limit(0)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    kind, langid._F = langid._F, np.float64
    try:
        w = {k: v.astype(np.float64) for k, v in langid.init(3, 4, 1).items()}
        x, y = rng.integers(0, 256, (3, 5), dtype=np.uint8), np.array([0, 2, 1])
        _, g = langid.gradients(w, x, y)
        for k in w:
            at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
            w[k][at] += 1e-5
            up = langid.gradients(w, x, y)[0]
            w[k][at] -= 2e-5
            down = langid.gradients(w, x, y)[0]
            w[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
    finally:
        langid._F = kind


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.query(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    odd = frame(spark, [(1, None), (2, ""), (3, "12 !"), (4, "hello " * 500)])
    langs, weights = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, langs, weights).collect()} == {"und"}
    langs, weights = langid.fit(docs)
    assert [r["lang_pred"] == "und" for r in langid.predict(odd, langs, weights).orderBy("doc_id").collect()] == [True, True, True, False]


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = [*corpus(), (1, "It's. don't, <|endoftext|> x<|ENDOFTEXT|>. 0a 1.5, a.,b ... !. É. ñ, <|startoftext|>"), (2, "a0b, 00 0 ."), (3, "a.\n,b! .c")]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.tokenize(frame(spark, docs)).cache()
    out = packing.pack(pieces).collect()
    want = {}
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p in range(0, len(ids), 2048):
            want[i, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want
    check_packing(out)
    assert packing.pack(packing.tokenize(frame(spark, docs[:1]).limit(0))).count() == 0


def check_packing(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


def test_bin_completion_is_optimal_on_small_inputs():
    rng = random.Random(4)

    def exact(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(40):
        items = sorted((rng.randrange(3, 40) for _ in range(9)), reverse=True)
        counts = np.bincount(items, minlength=51)
        plan, bound = packing.complete_bins(counts, 50)
        assert sorted((x for n, p in plan for x in p * n), reverse=True) == items and all(sum(p) <= 50 for _, p in plan)
        assert bound <= sum(n for n, _ in plan) == exact(items, 50)
