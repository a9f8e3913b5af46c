import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac


def back(streams):
    out = flac.decode_streams(streams)
    assert not any(r["error"] for r in out)
    return [b"".join((b + 128).astype(np.uint8).tobytes() for b in r["blocks"]) for r in out]


@settings(deadline=None, max_examples=25)
@given(st.lists(st.binary(min_size=0, max_size=1500), max_size=5), st.sampled_from([0, 1, 4, 12, 32]), st.booleans())
def test_round_trip(payloads, order, seek):
    padded = [p + b"\xff" * (-len(p) % 576) for p in payloads]
    assert back(flac.encode_payloads(padded, order, seek=seek)) == padded


def test_shapes_of_signals():
    rng = np.random.default_rng(2)
    signals = [bytes(576), b"\0\xff" * 576, rng.integers(0, 256, 5760, dtype=np.uint8).tobytes(), (128 + 90 * np.sin(np.arange(5760) / 9)).astype(np.uint8).tobytes(), b"a" * 575 + b"\xff"]
    streams = flac.encode_payloads(signals, 8)
    assert back(streams) == signals and len(streams[3]) < len(signals[3]) / 2
    many = b"x" * (576 * 200) + bytes(range(256)) * 9
    assert back(flac.encode_payloads([many], 4)) == [many]  # frame numbers of two bytes


def test_partitions_and_escapes_are_read():
    """A frame written by hand: fixed order 1, two partitions, the second escaped to 9-bit residuals."""
    x = np.zeros(576, dtype=np.int64)
    x[288:] = np.tile([-128, 127], 144)
    res = np.diff(x)
    bits = []
    put = lambda v, n: bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))
    put(9 << 1, 8)
    put(int(x[0]) & 255, 8)
    put(0, 2)
    put(1, 4)
    put(0, 4)
    for r in res[:287]:
        u = int(r) * 2 if r >= 0 else -2 * int(r) - 1
        put(1, u + 1)
    put(15, 4)
    put(9, 5)
    for r in res[287:]:
        put(int(r) & 511, 9)
    bits += [0] * (-len(bits) % 8)
    head, n = flac._header(np.array([0]))
    frame = head[0, : n[0]].tobytes() + np.packbits(bits).tobytes()
    row = np.frombuffer(frame, np.uint8)[None]
    frame += int(flac._crc(row, np.array([len(frame)]), flac._CRC16, 16)[0]).to_bytes(2, "big")
    got, size, _, end, ok = flac.decode_frames(np.frombuffer(frame + bytes(8), np.uint8), np.array([0]), np.array([8]))
    assert ok[0] and size[0] == 576 and end[0] == len(frame) and (got[0] == x).all()


def test_damage_is_found():
    stream = flac.encode_payloads([b"hello world " * 96])[0]
    for at in (len(stream) - 1, len(stream) - 200, len(stream) - 400):
        bad = bytearray(stream)
        bad[at] ^= 16
        assert flac.decode_streams([bytes(bad)])[0]["error"]
    for cut in (0, 3, 30, len(stream) - 5):
        assert flac.decode_streams([stream[:cut]])[0]["error"]


def test_seeking():
    payload = bytes(np.random.default_rng(0).integers(60, 120, 576 * 9, dtype=np.uint8))
    stream = flac.encode_payloads([payload])[0]
    for start, count in ((0, 10), (570, 20), (1152, 576), (5000, 900)):
        assert (flac.read_samples(stream, start, count) + 128).astype(np.uint8).tobytes() == payload[start : start + count]


def test_operator(spark):
    rows = [(1, "añb", 5, b"x"), (2, None, 6, b"y"), (3, "", 7, None), (4, "z" * 576, 8, None), (4, "z" * 576, 8, None), (None, "long " * 30_000, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media binary")
    stored = flac.encode(df)
    got = flac.decode(stored).collect()
    want = {i: flac.pad_texts([t])[0][0] for i, t, *_ in rows}
    assert len(got) == 6
    for r in got:
        payload = want[r["doc_id"]]
        assert r["error"] is None and (r["samples"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert b"".join(bytes(b["pcm"]) for b in r["blocks"]) == payload and [b["sample_offset"] for b in r["blocks"]] == list(range(0, len(payload), 576))
    assert flac.pcm_blocks(flac.decode(stored)).filter("doc_id = 4").count() == 2
    assert flac.decode(flac.encode(df.limit(0))).count() == 0
    odd = flac.decode(spark.createDataFrame([(1, None), (2, b"nonsense")], "doc_id long, media binary")).collect()
    assert odd[0]["samples"] is None and odd[1]["error"] == "no stream marker"


def test_query(spark):
    out = flac.query(spark, "/root/testdata/sf0.001")
    assert out.columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert out.filter("error is not null or payload_bytes % 576 <> 0").count() == 0


@pytest.mark.parametrize("text", ["", "x"])
def test_padding(text):
    assert len(flac.pad_texts([text])[0][0]) == 576
