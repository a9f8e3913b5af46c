"""FLAC media columns: a lossless store for 8-bit mono samples and its decoder.

The decoder reads Rice-coded residuals and fixed or quantised linear predictors, verifies the CRC-8 of each
frame header and the CRC-16 of each frame, and writes PCM blocks with their sample offsets. Streams carry a seek
point for each frame, so a batch decodes all frames of all streams side by side: step i of every frame is one
numpy operation. Streams without such points are walked frame by frame, again side by side.

Nulls: a null payload gives a null medium and no PCM blocks. An empty payload gives a stream without frames.
A stream that breaks a checksum or the format gives a row whose ``error`` says so, and no samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 576
#: Frames handled side by side; bounds the memory of a batch to a few dozen MB.
SIDE_BY_SIDE = 2048
_U = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top = [], 1 << (bits - 1)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, dtype=np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16 - i.bit_length() for i in range(1 << 16)], dtype=np.int64)


def _crc(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of the first ``lengths[f]`` bytes of each row, all rows in step."""
    crc = np.zeros(len(rows), dtype=np.uint32)
    mask, shift = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    least = int(lengths.min()) if len(lengths) else 0
    for j in range(int(lengths.max()) if len(lengths) else 0):
        new = (crc << np.uint32(8) & mask) ^ table[(crc >> shift) ^ rows[:, j]]
        crc = new if j < least else np.where(j < lengths, new, crc)
    return crc


# ---------------------------------------------------------------- encoder


def _lpc(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients and shifts of each frame, by Levinson's recursion over all frames at once."""
    f = x.astype(np.float64)
    n = f.shape[1]
    r = np.stack([np.einsum("fi,fi->f", f[:, k:], f[:, : n - k]) for k in range(order + 1)], axis=1)
    err = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), order))
    for i in range(order):
        acc = r[:, i + 1] - np.einsum("fj,fj->f", a[:, :i], r[:, i:0:-1]) if i else r[:, 1]
        k = acc / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(precision - 2 - np.floor(np.log2(np.maximum(most, 1e-9))).astype(np.int64), 0, 14)
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def _fold(res: np.ndarray) -> np.ndarray:
    return ((res << 1) ^ (res >> 63)).astype(_U)


def _rice(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Rice parameter of each row and the bits its residuals take, codes of at most 32 bits."""
    mean = folded.mean(axis=1)
    k0 = np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64)
    best_k, best = None, None
    top = folded.max(axis=1)
    for d in (-1, 0, 1):
        k = np.clip(k0 + d, 0, 14)
        bits = folded.shape[1] * (k + 1) + (folded >> k[:, None].astype(_U)).sum(axis=1).astype(np.int64)
        bits = np.where((top >> k.astype(_U)).astype(np.int64) + 1 + k > 32, 1 << 40, bits)
        best_k = k if best is None else np.where(bits < best, k, best_k)
        best = bits if best is None else np.minimum(bits, best)
    return best_k, best


def _pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write each row's fields (at most 32 bits each) one after another, MSB first; rows of bytes and their bit counts."""
    ends = np.cumsum(lengths, axis=1)
    at = ends - lengths
    words = int(ends[:, -1].max()) // 32 + 2
    n = len(values)
    shifted = values << (64 - lengths - (at & 31)).astype(_U)
    where = (at >> 5) + np.arange(n)[:, None] * words
    hi = (shifted >> _U(32)).astype(np.float64).ravel()  # sums of distinct bits below 2^32 are exact
    lo = (shifted & _U(0xFFFFFFFF)).astype(np.float64).ravel()
    out = np.bincount(where.ravel(), hi, minlength=n * words) + np.bincount(where.ravel() + 1, lo, minlength=n * words + 1)[: n * words]
    return out.astype(">u4").view(np.uint8).reshape(n, words * 4), ends[:, -1]


def _header(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers for blocks of 576 mono 8-bit samples with their CRC-8; bytes and lengths."""
    out = np.zeros((len(number), 12), dtype=np.uint8)
    out[:, :4] = (0xFF, 0xF8, 0x20, 0x02)
    size = 1 + (number >= 0x80).astype(int) + (number >= 0x800) + (number >= 0x10000) + (number >= 0x200000) + (number >= 0x4000000)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        v = number[rows]
        if n == 1:
            out[rows, 4] = v
        else:
            out[rows, 4] = (0xFF << (8 - n)) & 0xFF | v >> 6 * (n - 1)
            for j in range(1, n):
                out[rows, 4 + j] = 0x80 | v >> 6 * (n - 1 - j) & 0x3F
    length = 4 + size
    out[np.arange(len(number)), length] = _crc(out, length, _CRC8, 8)
    return out, length + 1


def _body(kind: int, x: np.ndarray, order: int, res: np.ndarray | None, coefs=None, shift=None, precision: int = 0, k=None):
    """Fields of subframes of one kind: (values, lengths)."""
    n = len(x)
    sample = (x & 0xFF).astype(_U)
    values, lengths = [np.full((n, 1), kind << 1, dtype=_U)], [np.full((n, 1), 8)]

    def add(v, bits):
        values.append(v)
        lengths.append(bits if isinstance(bits, np.ndarray) else np.full(v.shape, bits))

    if res is None:
        add(sample if kind == 1 else sample[:, :1], 8)
    else:
        if order:
            add(sample[:, :order], 8)
        if coefs is not None:
            add(np.full((n, 1), precision - 1, dtype=_U), 4)
            add(shift[:, None].astype(_U), 5)
            add((coefs & ((1 << precision) - 1)).astype(_U), precision)
        add(np.zeros((n, 1), dtype=_U), 6)  # Rice codes with 4-bit parameters, one partition
        add(k[:, None].astype(_U), 4)
        kk, folded = k[:, None], _fold(res)
        quotient = (folded >> kk.astype(_U)).astype(np.int64)
        add((_U(1) << kk.astype(_U)) | (folded & ((_U(1) << kk.astype(_U)) - _U(1))), quotient + 1 + kk)
    return np.concatenate(values, axis=1), np.concatenate(lengths, axis=1)


def encode_frames(x: np.ndarray, number: np.ndarray, lpc_order: int = 4, precision: int = 10) -> list[bytes]:
    """Frames of 576 signed 8-bit samples (one row each), the smallest of constant, verbatim, fixed or LPC subframes."""
    n = len(x)
    x = x.astype(np.int64)
    best = np.full(n, 8 * BLOCK + 8)
    choice = np.ones(n, dtype=np.int64)  # the subframe type; verbatim
    residuals, params = {}, {}
    fixed = [x]
    for _ in range(4):
        fixed.append(np.diff(fixed[-1], axis=1))
    sums = np.stack([np.abs(r[:, 4 - p :]).sum(axis=1) for p, r in enumerate(fixed)], axis=1)
    order = sums.argmin(axis=1)
    for p in range(5):
        rows = np.flatnonzero(order == p)
        if len(rows):
            k, bits = _rice(_fold(fixed[p][rows]))
            bits = bits + 18 + 8 * p
            better = bits < best[rows]
            residuals[8 + p], params[8 + p] = (rows, fixed[p][rows]), (k, None, None)
            choice[rows] = np.where(better, 8 + p, choice[rows])
            best[rows] = np.where(better, bits, best[rows])
    if lpc_order:
        coefs, shift = _lpc(x, lpc_order, precision)
        pred = np.zeros((n, BLOCK - lpc_order), dtype=np.int64)
        for j in range(lpc_order):
            pred += coefs[:, j : j + 1] * x[:, lpc_order - 1 - j : BLOCK - 1 - j]
        res = x[:, lpc_order:] - (pred >> shift[:, None])
        k, bits = _rice(_fold(res))
        bits = bits + 18 + 9 + lpc_order * (8 + precision)
        better = bits < best
        residuals[31 + lpc_order], params[31 + lpc_order] = (np.arange(n), res), (k, coefs, shift)
        choice = np.where(better, 31 + lpc_order, choice)
    choice = np.where((x == x[:, :1]).all(axis=1), 0, choice)
    head, head_len = _header(number)
    out: list[bytes] = [b""] * n
    for kind in np.unique(choice):
        rows = np.flatnonzero(choice == kind)
        if kind < 2:
            values, lengths = _body(int(kind), x[rows], 0, None)
        else:
            own, res = residuals[kind]
            k, coefs, shift = params[kind]
            pick = np.searchsorted(own, rows)
            p = kind - 8 if kind < 32 else kind - 31
            values, lengths = _body(int(kind), x[rows], int(p), res[pick], None if coefs is None else coefs[pick], None if shift is None else shift[pick], precision, k[pick])
        body, bits = _pack(values, lengths)
        size = (bits + 7) // 8
        hl = head_len[rows]
        frame = np.zeros((len(rows), int((size + hl).max()) + 2), dtype=np.uint8)
        for h in np.unique(hl):
            at = np.flatnonzero(hl == h)
            frame[at, :h] = head[rows[at], :h]
            frame[at, h : h + body.shape[1]] = body[at, : frame.shape[1] - h]
        total = size + hl
        crc = _crc(frame, total, _CRC16, 16)
        frame[np.arange(len(rows)), total] = crc >> 8
        frame[np.arange(len(rows)), total + 1] = crc & 0xFF
        for i, r in enumerate(rows):
            out[r] = frame[i, : total[i] + 2].tobytes()
    return out


def encode_payloads(payloads: list[bytes], lpc_order: int = 4, rate: int = 8000, seek: bool = True) -> list[bytes]:
    """Streams of payloads, each a multiple of 576 bytes; byte b is the sample b - 128."""
    counts = np.array([len(p) // BLOCK for p in payloads], dtype=np.int64)
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    first = np.concatenate(([0], np.cumsum(counts)))
    number = np.arange(len(data)) - np.repeat(first[:-1], counts)
    frames: list[bytes] = []
    for a in range(0, len(data), SIDE_BY_SIDE):
        frames += encode_frames(data[a : a + SIDE_BY_SIDE].astype(np.int16) - 128, number[a : a + SIDE_BY_SIDE], lpc_order)
    out = []
    for i, payload in enumerate(payloads):
        own = frames[first[i] : first[i + 1]]
        sizes = [len(f) for f in own]
        md5 = hashlib.md5((np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        table = b""
        if seek and own:
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            point = np.zeros(len(own), dtype=[("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
            point["sample"], point["at"], point["n"] = np.arange(len(own)) * BLOCK, at, BLOCK
            table = b"\x83" + (18 * len(own)).to_bytes(3, "big") + point.tobytes()
        out.append(b"fLaC" + (b"\x00" if table else b"\x80") + (34).to_bytes(3, "big") + info + table + b"".join(own))
    return out


# ---------------------------------------------------------------- decoder


class FlacError(ValueError):
    """A stream that breaks the format or a checksum."""


def parse_stream(data: bytes) -> dict:
    """STREAMINFO, the seek points and where the frames start."""
    if data[:4] != b"fLaC":
        raise FlacError("no stream marker")
    at, info, points = 4, None, np.empty((0, 3), dtype=np.int64)
    while True:
        if at + 4 > len(data):
            raise FlacError("metadata cut off")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if len(block) < size:
            raise FlacError("metadata cut off")
        if kind & 127 == 0:
            if size < 34:
                raise FlacError("short STREAMINFO")
            bits = int.from_bytes(block[10:18], "big")
            info = {"rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "bps": (bits >> 36 & 31) + 1, "samples": bits & (1 << 36) - 1, "md5": block[18:34], "max_block": int.from_bytes(block[2:4], "big")}
        elif kind & 127 == 3:
            raw = np.frombuffer(block[: size // 18 * 18], dtype=[("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
            raw = raw[raw["sample"] != 0xFFFFFFFFFFFFFFFF]
            points = np.stack([raw[c].astype(np.int64) for c in ("sample", "at", "n")], axis=1)
        at += 4 + size
        if kind & 128:
            break
    if info is None:
        raise FlacError("no STREAMINFO")
    if info["channels"] != 1 or info["bps"] > 24:
        raise FlacError("only mono streams of at most 24 bits")
    return info | {"points": points, "frames_at": at}


class _Bits:
    """Readers, one a row, over one buffer; all advance in step."""

    def __init__(self, buf: np.ndarray, pos: np.ndarray):
        self.win = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))
        self.pos = pos
        self.last = len(buf) - 8

    def peek(self, pos: np.ndarray) -> np.ndarray:
        return self.win[np.minimum(pos >> 3, self.last)].astype(_U) << (pos & 7).astype(_U)

    def read(self, bits, rows=slice(None)) -> np.ndarray:
        pos = self.pos[rows]
        bits = np.broadcast_to(np.asarray(bits, dtype=np.int64), pos.shape)
        out = (self.peek(pos) >> _U(1)) >> (63 - bits).astype(_U)
        self.pos[rows] = pos + bits
        return out.astype(np.int64)

    def signed(self, bits, rows=slice(None)) -> np.ndarray:
        v = self.read(bits, rows)
        return v - ((v >> (np.asarray(bits) - 1) & 1) << np.asarray(bits))

    def rice(self, k: np.ndarray, rows=slice(None)) -> np.ndarray:
        pos = self.pos[rows]
        w = self.peek(pos)
        q = _CLZ16[(w >> _U(48)).astype(np.int64)]
        if (q == 16).any():
            q = q.copy()
            more = np.flatnonzero(q == 16)
            while len(more):
                step = _CLZ16[(self.peek(pos[more] + q[more]) >> _U(48)).astype(np.int64)]
                q[more] += step
                more = more[(step == 16) & ((pos[more] + q[more]) >> 3 < self.last)]
            w = self.peek(pos + q) << _U(1)
        else:
            w = w << (q + 1).astype(_U)
        low = ((w >> _U(1)) >> (63 - k).astype(_U)).astype(np.int64)
        self.pos[rows] = pos + q + 1 + k
        u = (q << k) | low
        return (u >> 1) ^ -(u & 1)


_FIXED = np.zeros((5, 4), dtype=np.int64)
_FIXED[1, :1], _FIXED[2, :2], _FIXED[3, :3], _FIXED[4, :4] = (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)


def decode_frames(buf: np.ndarray, starts: np.ndarray, default_bps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode the frames at the given byte offsets. Returns samples (one row a frame), block sizes, frame numbers, ends, ok."""
    n = len(starts)
    bits = _Bits(buf, starts.astype(np.int64) * 8)
    ok = bits.read(15) == 0x7FFC
    variable = bits.read(1)
    size_code, rate_code = bits.read(4), bits.read(4)
    channel, bps_code = bits.read(4), bits.read(3)
    ok &= (bits.read(1) == 0) & (channel == 0) & (size_code > 0) & (rate_code < 15) & (variable == 0)
    lead = bits.read(8)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    number = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for j in range(int(extra.max()) if n else 0):
        rows = np.flatnonzero(extra > j)
        number[rows] = number[rows] << 6 | bits.read(8, rows) & 0x3F
    size = np.select([size_code == 1, (size_code >= 2) & (size_code <= 5), size_code >= 8], [192, 576 << np.clip(size_code - 2, 0, 3), 256 << np.clip(size_code - 8, 0, 7)], 0)
    for code, width in ((6, 8), (7, 16)):
        rows = np.flatnonzero(size_code == code)
        if len(rows):
            size[rows] = bits.read(width, rows) + 1
    for code, width in ((12, 8), (13, 16), (14, 16)):
        rows = np.flatnonzero(rate_code == code)
        if len(rows):
            bits.read(width, rows)
    bps = np.select([bps_code == 1, bps_code == 2, bps_code == 4, bps_code == 5, bps_code == 6], [8, 12, 16, 20, 24], default_bps)
    head = bits.pos // 8 - starts
    head_rows = buf[np.minimum(starts[:, None] + np.arange(int(head.max()) if n else 0), len(buf) - 1)]
    ok &= _crc(head_rows, head, _CRC8, 8) == bits.read(8)
    ok &= bits.read(1) == 0
    kind = bits.read(6)
    ok &= bits.read(1) == 0  # wasted bits aren't written by this store
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    coded = (kind >= 8) & (kind <= 12) | (kind >= 32)
    ok &= coded | (kind < 2)
    size = np.where(ok, size, 0)
    width = int(size.max()) if n else 0
    most = max(int(order.max()) if n else 0, 4)
    x = np.zeros((n, most + width), dtype=np.int64)  # `most` columns of zeros ahead of the samples
    rows = np.flatnonzero(ok & (kind == 0))
    if len(rows):
        x[rows, most:] = bits.signed(bps[rows], rows)[:, None]
    rows = np.flatnonzero(ok & (kind == 1))
    for i in range(int(size[rows].max()) if len(rows) else 0):
        rows = rows[size[rows] > i]
        x[rows, most + i] = bits.signed(bps[rows], rows)
    rows = np.flatnonzero(ok & coded)
    for i in range(int(order[rows].max()) if len(rows) else 0):
        own = rows[order[rows] > i]
        x[own, most + i] = bits.signed(bps[own], own)
    coefs, shift = np.zeros((n, most), dtype=np.int64), np.zeros(n, dtype=np.int64)
    own = rows[kind[rows] < 32]
    coefs[own, :4] = _FIXED[order[own]]
    own = rows[kind[rows] >= 32]
    if len(own):
        precision = bits.read(4, own) + 1
        shift[own] = bits.signed(5, own)
        for i in range(int(order[own].max())):
            has = order[own] > i
            coefs[own[has], i] = bits.signed(precision[has], own[has])
        ok[own[(precision == 16) | (shift[own] < 0)]] = False
        shift = np.maximum(shift, 0)
    rows = rows[ok[rows]]
    if len(rows):
        method = bits.read(2, rows)
        ok[rows[method > 1]] = False
        width_k = np.where(method == 1, 5, 4)
        parts = bits.read(4, rows)
        per = size[rows] >> parts
        k, raw = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1)
        sub_order, sub_size, sub_coefs, sub_shift = order[rows], size[rows], np.ascontiguousarray(coefs[rows].T), shift[rows]
        used = int(sub_order.max())
        single = not parts.any()
        columns = np.ascontiguousarray(x[rows].T)
        for i in range(width):
            due = (i == sub_order) if single else (i == sub_order) | (i > sub_order) & (i % np.maximum(per, 1) == 0) & (i < sub_size)
            if (i <= used or not single) and due.any():
                at = np.flatnonzero(due)
                k[at] = bits.read(width_k[at], rows[at])
                escaped = at[k[at] == (1 << width_k[at]) - 1]
                raw[at] = -1
                if len(escaped):
                    raw[escaped] = bits.read(5, rows[escaped])
            live = (i >= sub_order) & (i < sub_size)
            if not live.any():
                continue
            pred = sub_coefs[0] * columns[most + i - 1]
            for j in range(1, used):
                pred += sub_coefs[j] * columns[most + i - 1 - j]
            pred >>= sub_shift
            if live.all() and (raw < 0).all():
                columns[most + i] = pred + (bits.rice(k) if len(rows) == n else bits.rice(k, rows))
            else:
                at = np.flatnonzero(live & (raw < 0))
                columns[most + i, at] = pred[at] + bits.rice(k[at], rows[at])
                at = np.flatnonzero(live & (raw > 0))
                if len(at):
                    columns[most + i, at] = pred[at] + bits.signed(raw[at], rows[at])
                at = np.flatnonzero(live & (raw == 0))
                columns[most + i, at] = pred[at]
        x[rows] = columns.T
    ends = (bits.pos + 7) // 8
    length = np.where(ok, ends - starts, 0)
    ok &= ends + 2 <= len(buf) - 8
    crc = np.zeros(n, dtype=np.uint32)
    if n:
        length = np.where(ok, length, 0)
        frame = buf[np.minimum(starts[:, None] + np.arange(max(int(length.max()), 1)), len(buf) - 1)]
        crc = _crc(frame, length, _CRC16, 16)
    stop = np.minimum(ends, len(buf) - 2)
    ok &= crc == buf[stop].astype(np.uint32) << np.uint32(8) | buf[stop + 1]
    return x[:, most:], size, number, ends + 2, ok


def decode_streams(streams: list[bytes]) -> list[dict]:
    """Decode streams side by side. Each result has info and ``pcm`` (int samples), ``offsets`` of its blocks, or ``error``."""
    out: list[dict] = []
    jobs, base, at = [], [], 0
    for i, data in enumerate(streams):
        try:
            out.append(parse_stream(data) | {"error": None, "blocks": []})
            base.append(at)
            jobs.append(i)
        except FlacError as e:
            out.append({"error": str(e), "blocks": []})
            base.append(at)
        at += len(data)
    buf = np.frombuffer(b"".join(streams) + b"\0" * 8, dtype=np.uint8)
    walk, todo = [], []
    for i in jobs:
        r = out[i]
        p = r["points"]
        full = len(p) and p[0, 0] == 0 and (p[1:, 0] == p[:-1, 0] + p[:-1, 2]).all() and p[-1, 0] + p[-1, 2] == r["samples"]
        if full:
            todo += [(i, base[i] + r["frames_at"] + int(a)) for a in p[:, 1]]
        elif r["samples"]:
            walk.append((i, base[i] + r["frames_at"]))

    def run(batch: list[tuple[int, int]]) -> list[int]:
        starts = np.array([s for _, s in batch], dtype=np.int64)
        bps = np.array([out[i]["bps"] for i, _ in batch])
        inside = starts < len(buf) - 8
        x, size, _, ends, ok = decode_frames(buf, np.where(inside, starts, 0), bps)
        ok &= inside & (ends <= np.array([base[i] + len(streams[i]) for i, _ in batch]))
        small = np.int16 if bps.max() <= 16 else np.int32
        for j, (i, _) in enumerate(batch):
            if ok[j]:
                out[i]["blocks"].append(x[j, : size[j]].astype(small))
            else:
                out[i]["error"] = out[i]["error"] or f"bad frame {len(out[i]['blocks'])}"
        return [int(e) for e in ends]

    for a in range(0, len(todo), SIDE_BY_SIDE):
        run(todo[a : a + SIDE_BY_SIDE])
    while walk:
        after = []
        for a in range(0, len(walk), SIDE_BY_SIDE):
            batch = walk[a : a + SIDE_BY_SIDE]
            for (i, _), end in zip(batch, run(batch), strict=True):
                if not out[i]["error"] and sum(map(len, out[i]["blocks"][-1:])) and sum(map(len, out[i]["blocks"])) < out[i]["samples"]:
                    after.append((i, end))
        walk = after
    for r in out:
        if r["error"]:
            r["blocks"] = []
        elif sum(map(len, r["blocks"])) != r["samples"]:
            r["error"], r["blocks"] = "wrong number of samples", []
        sizes = [len(b) for b in r["blocks"]]
        r["offsets"] = [0, *np.cumsum(sizes)[:-1]] if sizes else []
    return out


# ---------------------------------------------------------------- operators


def pad_texts(texts: list[str | None]) -> tuple[list[bytes], list[int]]:
    raw = [(t or "").encode("utf-8") for t in texts]
    return [t + b"\xff" * (-len(t) % BLOCK or (0 if t else BLOCK)) for t in raw], [len(t) for t in raw]


def _slices(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[pa.Array]:
    """Parts of a batch that hold about ``most_bytes`` of text or bytes each (one value is never cut)."""
    sizes = np.cumsum([0 if not v.is_valid else len(v.as_buffer()) for v in column])
    start = 0
    while start < len(column):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
        yield slice(start, stop)
        start = stop


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lpc_order: int = 4) -> DataFrame:
    """Store each text as a FLAC stream: ``(doc_id, n_bytes, media)``. A null text counts as empty.

    Other columns of ``docs`` are ignored, whatever their names. Repeated rows give repeated streams.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = source.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in _slices(texts):
                payloads, sizes = pad_texts(texts[part].to_pylist())
                yield pa.RecordBatch.from_arrays([ids[part], pa.array(sizes, pa.int64()), pa.array(encode_payloads(payloads, lpc_order), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, schema)


def features(pcm: np.ndarray) -> str:
    """Integer features of signed samples: peak, energy, mean magnitude in 1/1000, sign changes, largest step."""
    if not len(pcm):
        return "n=0"
    x = pcm.astype(np.int64)
    a = np.abs(x)
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    step = int(np.abs(np.diff(x)).max()) if len(x) > 1 else 0
    return f"n={len(x)};peak={a.max()};energy={int((x * x).sum())};level={int(a.sum()) * 1000 // len(x)};changes={changes};step={step}"


DECODED = "doc_id {id}, samples long, error string, media_bytes long, media_sha256 string, payload_sha256 string, tail_crc32 long, feature string, blocks array<struct<sample_offset:long,n_samples:int,pcm:binary>>"


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep_blocks: bool = True) -> DataFrame:
    """Decode FLAC streams: one row each with digests of the 8-bit payload, features and, if asked for, its PCM blocks.

    ``blocks`` holds (sample_offset, n_samples, pcm) of each frame, so a reader can seek to any sample.
    A null stream gives nulls; a broken one gives ``error`` and no samples. PCM is unsigned 8-bit (or little-endian
    signed 32-bit for wider samples).
    """
    source = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = DECODED.format(id=source.schema["doc_id"].dataType.simpleString())
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))

    def raw(block: np.ndarray, bps: int) -> bytes:
        return (block + 128).astype(np.uint8).tobytes() if bps == 8 else block.astype("<i4").tobytes()

    def run(batches):
        for batch in batches:
            ids, streams = batch.column(0), batch.column(1)
            for part in _slices(streams):
                given = streams[part].to_pylist()
                decoded = iter(decode_streams([s for s in given if s is not None]))
                rows = []
                for s in given:
                    if s is None:
                        rows.append((None,) * 8)
                        continue
                    r = next(decoded)
                    if r["error"]:
                        rows.append((None, r["error"], len(s), hashlib.sha256(s).hexdigest(), None, None, None, None))
                        continue
                    pcm = np.concatenate(r["blocks"]) if r["blocks"] else np.empty(0, dtype=np.int16)
                    payload = raw(pcm, r["bps"])
                    error = None
                    if r["bps"] == 8 and any(r["md5"]) and hashlib.md5((pcm.astype(np.int8)).tobytes()).digest() != r["md5"]:
                        error = "wrong MD5"
                    blocks = [{"sample_offset": int(o), "n_samples": len(b), "pcm": raw(b, r["bps"])} for o, b in zip(r["offsets"], r["blocks"], strict=True)] if keep_blocks else None
                    rows.append((r["samples"], error, len(s), hashlib.sha256(s).hexdigest(), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), features(pcm), blocks))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), kind]
                names = ["samples", "error", "media_bytes", "media_sha256", "payload_sha256", "tail_crc32", "feature", "blocks"]
                yield pa.RecordBatch.from_arrays([ids[part], *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return source.mapInArrow(run, schema)


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """The PCM blocks of decoded streams, one row each: ``(doc_id, sample_offset, n_samples, pcm)``."""
    return decoded.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.sample_offset", "b.n_samples", "b.pcm")


def read_samples(data: bytes, start: int, count: int) -> np.ndarray:
    """Samples ``start`` to ``start + count`` of a stream, decoding only the frames that hold them, by its seek points."""
    r = parse_stream(data)
    p = r["points"]
    if not len(p):
        whole = decode_streams([data])[0]
        if whole["error"]:
            raise FlacError(whole["error"])
        return np.concatenate(whole["blocks"])[start : start + count]
    pick = p[(p[:, 0] < start + count) & (p[:, 0] + p[:, 2] > start)]
    buf = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    x, size, _, _, ok = decode_frames(buf, r["frames_at"] + pick[:, 1], np.full(len(pick), r["bps"]))
    if not ok.all():
        raise FlacError("bad frame")
    if not len(pick):
        return np.empty(0, dtype=np.int64)
    whole = np.concatenate([row[:n] for row, n in zip(x, size, strict=True)])
    return whole[start - pick[0, 0] : start - pick[0, 0] + count]


def query(spark, sf_dir: str) -> DataFrame:
    """Whole texts of ``documents`` stored as FLAC, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = encode(docs)
    back = decode(stored.select("doc_id", F.struct("media", "n_bytes").alias("m")).select(F.struct("doc_id", "m.n_bytes").alias("doc_id"), "m.media"), keep_blocks=False)
    return back.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.n_bytes").alias("n_bytes"), F.col("samples").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
