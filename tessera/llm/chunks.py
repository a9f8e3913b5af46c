"""Documents as chunks, and the exchange by which chunks learn about each other's keys.

A chunk is a row of a written table: some parts of a few MB of whole documents each, compressed. Work on words takes
a part at a time; what a chunk asks of the others is put together for all its parts, so few messages are sent.

For an exchange, each chunk sends its distinct 64-bit keys, sorted, to equal spans of the key space (buckets). Within
a bucket a key is its place in the span, sorted too, so differences are small: they are sent as byte planes, compressed.
A bucket answers each key of each message with one byte; the answers come back to their chunk in the order of its keys.
However often a key occurs in a chunk, it is sent once, so one that a third of all documents hold costs a bucket one
entry a chunk. Joins by chunk are sort-merge joins at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash

PART_BYTES = 4_000_000
PARTS = 8
BUCKET_BYTES = 48_000_000
PLACE_BITS = 26
MESSAGES = "bucket long, chunk long, n int, body binary"


def to_chunks(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES, parts: int = PARTS, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``(chunk, size, parts)``, written once, so a chunk's name (its partition and number) stays. A part has ``ids``, ``sizes`` and
    ``body``, and, where ``carry`` names columns (none of them will do), ``rest`` with ``no_text`` and those columns in ``cols``."""
    rest = F.struct(F.col(text_col).isNull().alias("no_text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("cols")] if carry else []))
    carries = carry is not None
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"), *([rest.alias("rest")] if carries else []))

    def run(batches):
        made, ids, texts, others, size, total, number, part, kind = [], [], [], [], 0, 0, 0, 0, None

        def close():
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            made.append({"ids": list(ids), "sizes": [len(t) for t in texts], "body": body} | ({"rest": list(others)} if carries else {}))
            for x in (ids, texts, others):
                x.clear()

        def chunk():
            fields = [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()), *([("rest", pa.list_(kind))] if carries else [])]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([total], pa.int64()), pa.array([made], pa.list_(pa.struct(fields)))], names=["chunk", "size", "parts"])

        for batch in batches:
            more = batch.column(3).to_pylist() if carries else [None] * batch.num_rows
            kind = batch.schema.field(3).type if carries else None
            for i, text, p, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), more, strict=True):
                part = p
                ids.append(i)
                others.append(other)
                texts.append((text.as_py() or "").encode("utf-8"))
                size += len(texts[-1])
                if size >= part_bytes:
                    close()
                    total, size = total + size, 0
                    if len(made) == parts:
                        yield chunk()
                        made, total, number = [], 0, number + 1
        if ids:
            close()
            total += size
        if made:
            yield chunk()

    kept = f", rest: array<{source.schema['rest'].dataType.simpleString()}>" if carries else ""
    return stash(source.mapInArrow(run, f"chunk long, size long, parts array<struct<ids: array<bigint>, sizes: array<bigint>, body: binary{kept}>>"), "chunks")


def slim(chunks: DataFrame) -> DataFrame:
    """Chunks without the columns that they carry along."""
    return chunks.select("chunk", "size", F.transform("parts", lambda p: F.struct(p["ids"].alias("ids"), p["sizes"].alias("sizes"), p["body"].alias("body"))).alias("parts"))


def bucket_count(chunks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return int(max(32, (chunks.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))


def rows(batches) -> Iterator[tuple[int, list[dict], pa.RecordBatch]]:
    """Chunks of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield one.column("chunk")[0].as_py(), one.column("parts").to_pylist()[0], one


def texts_of(part: dict) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(part["body"]) if sum(part["sizes"]) else b""
    ends = np.cumsum([0, *part["sizes"]])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed byte planes of their differences."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_sorted(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if n else np.empty(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)


def places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key and its place there; both ascend with the keys."""
    b = np.uint64(buckets)
    bucket = ((keys >> np.uint64(32)) * b + ((keys & np.uint64(0xFFFFFFFF)) * b >> np.uint64(32))) >> np.uint64(32)
    return bucket.astype(np.int64), (keys * b >> np.uint64(64 - PLACE_BITS)).astype(np.uint32)


def messages(chunk: int, keys: np.ndarray, buckets: int, body: Callable[[int, int, np.ndarray], bytes] | None = None) -> pa.RecordBatch:
    """Messages of a chunk's sorted distinct keys, one a bucket. ``body`` makes one from a span of the keys; else their places are sent."""
    bucket, place = places(keys, buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(keys) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(keys)) if len(keys) else cuts
    bodies = [body(a, b, place[a:b]) if body else pack_sorted(place[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts], pa.int64()), pa.array(np.full(len(cuts), chunk), pa.int64()), pa.array(ends - cuts, pa.int32()), pa.array(bodies, pa.binary())],
        names=["bucket", "chunk", "n", "body"],
    )


def exchange(sent: DataFrame, judge: Callable[[np.ndarray], np.ndarray], label: str, read: Callable[[list[bytes], np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """A written table of answers: for each message, the bytes that ``judge`` gives to its keys, compressed.

    ``judge`` sees all keys that reached a bucket, message after message, as ``read`` gives them (as places by default).
    """

    def run(table: pa.Table) -> pa.Table:
        n = np.array(table["n"].to_pylist(), dtype=np.int64)
        bodies = table["body"].to_pylist()
        keys = read(bodies, n) if read else np.concatenate([unpack_sorted(b, k) for b, k in zip(bodies, n.tolist(), strict=True)])
        verdicts, ends = judge(keys).astype(np.uint8), np.cumsum(n)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out = [squeeze(verdicts[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "n": table["n"], "body": pa.array(out, pa.binary())})

    return stash(sent.groupBy("bucket").applyInArrow(run, MESSAGES), label)


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with ``bits``: all answers that came back to them, by ``level`` (their place among ``answers``)."""
    all_of = None
    for level, a in enumerate(answers):
        a = a.select("chunk", F.struct(F.lit(level).alias("level"), "bucket", "n", "body").alias("b"))
        all_of = a if all_of is None else all_of.unionByName(a)
    own = all_of.groupBy("chunk").agg(F.collect_list("b").alias("bits"))
    return chunks.hint("merge").join(own.hint("merge"), "chunk", "left")


def answers_of(one: pa.RecordBatch, level: int, total: int) -> np.ndarray:
    """The bytes that came back to a chunk's keys, in the order of the keys."""
    bits = [b for b in one.column("bits").to_pylist()[0] or [] if b["level"] == level]
    bits.sort(key=lambda b: b["bucket"])
    whole = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b["body"]) for b in bits), np.uint8)
    if len(whole) != total:
        raise RuntimeError(f"{total} keys were sent and {len(whole)} answers came back")
    return whole
