"""Substring dedup by level-wise doubling.

Windows are judged at a short length first; only those repeated there are extended to twice that length, and so on until
the length asked for (4, 8 and 13 words for windows of 13), or until no candidates survive. A window repeats if its words
also start in a document with a smaller doc_id.

Documents travel once as compressed chunks, written to the shared folder. For a level, each chunk sends a short fingerprint
of each of its distinct candidate windows to the fingerprint's bucket, and gets one byte back for each. However often a
window occurs in a chunk, it is sent once, so a passage or copy that a third of all documents hold costs a bucket one
entry a chunk. Fingerprints of a level that only filters may collide (that costs a candidate more); the last level compares
96 bits and the smallest doc_id of each chunk.

A level that only filters samples: a window of the final length holds several shorter ones, and it sends the one with the
smallest hash (equal windows choose equal ones). That is a part of the windows and loses none.

Nulls and empty texts have no words. Repeated rows with one doc_id are one document to each other: neither removes
the other's words. Null ids count as larger than all others, and are equal to each other. Of equal windows in one document none is
removed for the other. An empty table gives no rows. Texts are never cut, however long; other columns are ignored, or carried
along whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import MESSAGES, answers_of, bucket_count, exchange, messages, rows, slim, texts_of, to_chunks, with_answers
from tessera.llm.common import Words, discard, stash, window_hashes

START = 4
CHUNK_PARTS = 4
PART_BYTES = 3_000_000
BASE_A, BASE_B = 0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F
LAST_ID = np.iinfo(np.int64).max


def widths(window: int, start: int = START) -> list[int]:
    """The lengths judged on the way to ``window``: each twice the one before, the last cut to it."""
    out, width = [], start
    while width < window:
        out.append(width)
        width *= 2
    return [*out, window]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Part:
    """The words of some documents and which windows of the final length are still candidates."""

    def __init__(self, part: dict, window: int):
        self.ids, self.texts = part["ids"], texts_of(part)
        self.words = Words(self.texts)
        self.h = self.words.hashes()
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.words.first))
        self.order = np.array([LAST_ID if i is None else i for i in self.ids], dtype=np.int64)
        n = max(0, len(self.h) - window + 1)
        self.alive = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n else np.empty(0, np.int64)

    def chosen(self, width: int, window: int) -> np.ndarray:
        """For each candidate: the smallest hash of the windows of ``width`` words in it."""
        h = window_hashes(self.h, width, BASE_A)
        n = max(0, len(self.h) - window + 1)
        low = h[:n].copy()
        for j in range(1, window - width + 1):
            np.minimum(low, h[j : j + n], out=low)
        return low[self.alive]

    def grouped(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct values, and which of them occur in two documents here."""
        doc = self.doc[self.alive]
        new = _runs(low, doc)
        low, doc = low[new], doc[new]
        by = np.argsort(low, kind="stable")  # documents stay in order
        low, doc = low[by], doc[by]
        heads = np.flatnonzero(_runs(low))
        return low[heads], doc[heads] < doc[np.append(heads[1:], len(low)) - 1] if len(low) else np.empty(0, bool)


def _filter_level(parts: list[Part], width: int, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A chunk's distinct fingerprints of a level, which of them two of its documents hold, and each part's choices."""
    lows = [p.chosen(width, window) for p in parts]
    found = [p.grouped(low) for p, low in zip(parts, lows, strict=True)]
    values, at, count = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True, return_counts=True)
    here = count > 1
    here[at[np.concatenate([r for _, r in found])]] = True
    return values, here, lows


def _final_level(parts: list[Part], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A chunk's distinct keys of the candidates, sorted, with the smallest doc_id here; and each part's candidates' numbers."""
    a = np.concatenate([window_hashes(p.h, window, BASE_A ^ 0x5555555555555554)[p.alive] for p in parts])
    b = np.concatenate([window_hashes(p.words.hashes(1), window, BASE_B)[p.alive] >> np.uint64(32) for p in parts])
    order = np.concatenate([p.order[p.doc[p.alive]] for p in parts])
    by = np.lexsort((order, b, a))
    new = _runs(a[by], b[by])
    heads = by[new]
    number = np.empty(len(a), np.int64)
    number[by] = np.cumsum(new) - 1
    return a[heads], b[heads], order[heads], np.split(number, np.cumsum([len(p.alive) for p in parts])[:-1])


def _replay(parts: list[dict], one: pa.RecordBatch, done: list[int], window: int) -> list[Part]:
    """A chunk's parts after the levels ``done``, whose answers are in ``one``."""
    out = [Part(p, window) for p in parts]
    for level, width in enumerate(done):
        values, here, lows = _filter_level(out, width, window)
        hit = here | (answers_of(one, level, len(values)) > 0)
        for p, low in zip(out, lows, strict=True):
            p.alive = p.alive[hit[np.searchsorted(values, low)]] if len(low) else p.alive
    return out


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _final_body(a: np.ndarray, b: np.ndarray, least: np.ndarray):
    def body(i: int, j: int, _) -> bytes:
        low = least[i:j].min()
        ids = (least[i:j].view(np.uint64) - low.view(np.uint64)).astype("<u8")
        return low.tobytes() + zstandard.ZstdCompressor(level=1).compress(_planes(a[i:j].astype("<u8")) + _planes(b[i:j].astype("<u4")) + _planes(ids))

    return body


def _read_final(bodies: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, tails, ids = [], [], []
    for body, k in zip(bodies, n.tolist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(body[8:])
        keys.append(_unplanes(raw[: 8 * k], k, "<u8"))
        tails.append(_unplanes(raw[8 * k : 12 * k], k, "<u4"))
        ids.append((_unplanes(raw[12 * k :], k, "<u8") + np.frombuffer(body[:8], "<u8")[0]).view(np.int64))
    return np.concatenate(keys), np.concatenate(tails), np.concatenate(ids)


def _elsewhere(keys: np.ndarray) -> np.ndarray:
    """Whether another chunk has the key (a chunk sends each once)."""
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    return (count > 1)[at]


def _smaller(keys: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """1 where another chunk has the key with a smaller doc_id, 2 where one has it with a larger one alone."""
    a, b, order = keys
    by = np.lexsort((order, b, a))
    o = order[by]
    heads = np.flatnonzero(_runs(a[by], b[by]))
    sizes = np.diff(np.append(heads, len(by)))
    out = np.empty(len(by), np.uint8)
    out[by] = np.where(o > np.repeat(o[heads], sizes), 1, np.where(o < np.repeat(o[heads + sizes - 1], sizes), 2, 0))
    return out


def _levels(chunks: DataFrame, window: int, start: int) -> tuple[list[int], list[DataFrame], bool]:
    """The filtering lengths that were judged, the answers of all levels, and whether candidates survived to the last one."""
    buckets, done, answers = bucket_count(chunks), [], []
    for width in widths(window, start):
        last, before = width == window, list(done)

        def ask(batches, width=width, last=last, before=before):
            for chunk, parts, one in rows(batches):
                alive = _replay(parts, one, before, window)
                if last:
                    a, b, least, _ = _final_level(alive, window)
                    # equal first halves with different tails lie together, so the keys are sorted but not distinct in ``a``
                    yield messages(chunk, a, buckets, _final_body(a, b, least))
                else:
                    yield messages(chunk, _filter_level(alive, width, window)[0], buckets)

        sent = (with_answers(chunks, *answers) if answers else chunks).mapInArrow(ask, MESSAGES)
        answers.append(exchange(sent, _smaller, "final", _read_final) if last else exchange(sent, _elsewhere, "level"))
        if last:
            return done, answers, True
        done.append(width)
        if answers[-1].isEmpty():  # nothing was sent: no candidates survive
            return done, answers, False


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, start: int = START, part_bytes: int = PART_BYTES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Per document ``(doc_id, n_words, n_removed, kept_sha256)`` and the kept text: words covered by a repeated window go.

    Without ``carry``, ``kept`` is the kept words. With ``carry``, the columns named travel with the chunks: ``carried.cols`` holds them, and ``whole`` the text as it was
    where nothing was removed, else the kept words. So no text is joined to its row again."""
    if window < 2:
        raise ValueError("a window has two words at least")
    written = to_chunks(docs, id_col, text_col, part_bytes, CHUNK_PARTS, carry)
    done, answers, survive = _levels(written if carry is None else slim(written), window, start)

    def clean(batches):
        for _, given, one in rows(batches):
            parts = _replay(given, one, done, window)
            if survive:
                _, _, least, numbers = _final_level(parts, window)
                far = answers_of(one, len(done), len(least)) == 1
            for k, p in enumerate(parts):
                gone = np.empty(0, np.int64)
                if survive:
                    gone = p.alive[far[numbers[k]] | (p.order[p.doc[p.alive]] > least[numbers[k]])]
                edge = np.zeros(len(p.h) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, np.minimum(gone + window, len(p.h)), -1)
                yield from _cleaned(p, np.cumsum(edge)[:-1] == 0, given[k].get("rest"), one.schema)

    last = f"whole string, carried {written.schema['parts'].dataType.elementType['rest'].dataType.elementType.simpleString()}" if carry is not None else "kept string"
    return with_answers(written, *answers).mapInArrow(clean, f"doc_id long, n_words long, n_removed long, kept_sha256 string, {last}")


def _cleaned(p: Part, keep: np.ndarray, rest: list | None, schema: pa.Schema):
    """Rows of a part's documents, from which words are kept as told."""
    f, out = p.words.first, []
    for i, text in enumerate(p.texts):
        words = text.split()
        if not keep[f[i] : f[i + 1]].all():
            words = [words[j] for j in np.flatnonzero(keep[f[i] : f[i + 1]])]
        kept = b" ".join(words)
        n = int(f[i + 1] - f[i])
        row = [p.ids[i], n, n - len(words), hashlib.sha256(kept).hexdigest()]
        if rest is None:
            row.append(kept.decode("utf-8"))
        else:
            row += [None if rest[i]["no_text"] else (kept if len(words) < n else text).decode("utf-8"), rest[i]]
        out.append(row)
    types, names = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    if rest is not None:
        of_part = schema.field("parts").type.value_type
        types, names = [*types, of_part.field(of_part.get_field_index("rest")).type.value_type], [*names[:4], "whole", "carried"]
    for s in range(0, len(out), 256):  # small batches on the way back
        columns = list(zip(*out[s : s + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start: int = 13, part_bytes: int = PART_BYTES) -> DataFrame:
    """Doubling without a last length: ``(doc_id, longest)``, the largest ``start`` * 2^k at which a window of the
    document repeats one of a smaller doc_id; documents without one are left out. Ends when no candidates survive.

    Each round goes on with the documents that hold a window which another one holds, in whichever of the two.
    """
    if start < 2:
        raise ValueError("a window has two words at least")
    source, width, found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), start, None
    while True:
        written = to_chunks(source, "doc_id", "text", part_bytes, CHUNK_PARTS)
        done, answers, survive = _levels(written, width, min(START, width))

        def survivors(batches, width=width, done=done):
            for _, given, one in rows(batches):
                parts = _replay(given, one, done, width)
                _, _, least, numbers = _final_level(parts, width)
                far = answers_of(one, len(done), len(least))
                most = np.full(len(least), np.iinfo(np.int64).min)
                for k, p in enumerate(parts):
                    np.maximum.at(most, numbers[k], p.order[p.doc[p.alive]])
                out = []
                for k, p in enumerate(parts):
                    shared = (far[numbers[k]] > 0) | (most > least)[numbers[k]]
                    later = (far[numbers[k]] == 1) | (p.order[p.doc[p.alive]] > least[numbers[k]])
                    late = set(p.doc[p.alive[later]].tolist())
                    out += [(p.ids[d], p.texts[d].decode("utf-8"), d in late) for d in np.unique(p.doc[p.alive[shared]]).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["doc_id", "text", "later"])

        level = stash(with_answers(written, *answers).mapInArrow(survivors, "doc_id long, text string, later boolean"), f"doubling{width}") if survive else None
        discard(written, *answers)
        own = level.filter("later").select("doc_id").distinct().withColumn("longest", F.lit(width)) if level is not None else source.limit(0).select("doc_id", F.lit(width).alias("longest"))
        found = own if found is None else found.unionByName(own)
        if level is None or level.isEmpty():
            return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        source, width = level.select("doc_id", "text"), 2 * width


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats(docs).drop("kept")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Documents without repeated passages; those with none keep their text as it is. The columns of ``docs`` stay."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = repeats(docs, carry=rest)
    fixed = F.col("n_removed") > 0
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("whole")}
    if "n_chars" in rest:
        made["n_chars"] = F.when(fixed, F.char_length("whole").cast("long")).otherwise(F.col("carried")["cols"]["n_chars"])
    return cut.select(*[made[c].alias(c) if c in made else F.col("carried")["cols"][c].alias(c) for c in docs.columns])
