"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by bin completion.

Executors tokenise whole texts (a word cache feeds the tokenizer only unseen words) and cut over-long documents.
What is packed is the histogram of piece lengths: at most ``capacity`` numbers, whatever the input's size. Bin
completion takes the largest length left, enumerates undominated fillings of the room beside it, least waste
first, and applies a filling as often as the counts allow, then less often. Branches whose waste exceeds what would
beat the incumbent are pruned; best-fit decreasing is the first incumbent, and reaching the volume bound ends the
search. It stops after ``node_limit`` nodes (fillings applied); the packing at hand is then completed by best fit,
and the better of it and the incumbent, always whole packings, is the result.

The plan says which ranks of each length go to which sequences; ranks are dealt in salted groups, so a length that
a third of all pieces share is no hot spot.

Nulls and empty texts are the single id 0. Repeated rows are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash

CAPACITY = 2048
CACHE_WORDS = 400_000
PATIENCE = 100
BROADCAST_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SAFE = re.compile(rb"[^0-9<]*\Z")
_JOINED = 400
_CACHES: dict[str, WordCache] = {}
_LETTER, _SPACE, _MARKS = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\x20\x09\x0a\x0b\x0c\x0d", b".,"))


def split_words(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text that are encoded one by one.

    ASCII capitals are lowered as the tokenizer does, but for texts with ``<|``. A full stop or comma after an ASCII
    letter and before white space is a token group of its own, so it is split off: far fewer distinct words.
    """
    raw = [(t or "").encode("utf-8") for t in texts]
    raw = [t if b"<|" in t else t.lower() for t in raw]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    at = np.flatnonzero(_MARKS[joined[1:-1]] & _LETTER[joined[:-2]] & _SPACE[joined[2:]]) + 1
    spaced = np.insert(joined, at, 32).tobytes()
    ends = np.cumsum([0, *(len(t) + 1 for t in raw)])
    ends += np.searchsorted(at, ends)
    return [spaced[a:b].split() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class WordCache:
    """Token ids of words; unseen words of a batch are encoded together, joined by a word with a single id.

    It lives as long as its Python worker. When it exceeds ``limit`` words, those not met again in a later batch are dropped
    (all, if more than half were), which bounds memory and changes no result.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.separator = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.clear()

    @classmethod
    def of_worker(cls, path: str) -> WordCache:
        if path not in _CACHES:
            _CACHES[path] = cls(path)
        return _CACHES[path]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.met = np.empty(0, bool)

    def trim(self) -> None:
        index, kept = self.index, np.flatnonzero(self.met)
        if 2 * len(kept) > self.limit:
            return self.clear()
        words, sizes = list(index), self.sizes[kept].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[kept] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.clear()
        self._learn([words[i] for i in kept.tolist()], flat, sizes)

    def _one_by_one(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)]

    def _learn(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)))
        self.ids, self.sizes = np.concatenate((self.ids, flat)), np.concatenate((self.sizes, sizes.astype(np.int32)))
        self.met = np.concatenate((self.met, np.zeros(len(words), bool)))

    def learn(self, words: list[bytes]) -> None:
        safe, odd = [], []
        for w in words:
            (safe if _SAFE.match(w) and len(self.separator) == 1 else odd).append(w)
        groups = [safe[i : i + _JOINED] for i in range(0, len(safe), _JOINED)]
        coded = self.tokenizer.encode_batch_fast([b" 0 ".join([*g, b""]).decode("utf-8") for g in groups], add_special_tokens=False) if groups else []
        flats, sizes, known = [], [], []
        for g, e in zip(groups, coded, strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(ids == self.separator[0])
            if len(ends) != len(g):
                odd += g
                continue
            known += g
            flats.append(ids[ids != self.separator[0]])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        if odd:
            lists = self._one_by_one(odd)
            known += odd
            flats.append(np.fromiter((i for c in lists for i in c), np.uint32))
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        self._learn(known, np.concatenate(flats), np.concatenate(sizes))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words on end, and how many each has."""
        if len(self.index) > self.limit:
            self.trim()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(missing):
            unseen = [words[i] for i in missing]
            self.learn(list(dict.fromkeys(unseen)))
            at[missing] = np.fromiter(map(self.index.__getitem__, unseen), np.int32, len(unseen))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        flat = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        return flat, sizes


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens (a document's ids and a closing 0); ``with_ids`` adds the ids themselves."""
    path = path or tokenizer_path()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        cache = WordCache.of_worker(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and (not part or size < 1_000_000):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                group = split_words(part)
                flat, sizes = cache.encode(list(chain.from_iterable(group)))
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, group)])]
                rows = []
                for k in range(len(group)):
                    own = np.append(flat[ends[k] : ends[k + 1]], np.uint32(0)).astype("<u4")
                    for p, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((ids[at + k], p, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                at += len(group)

    return source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- the plan

Plan = list[tuple[int, list[int]]]  # how many sequences hold these lengths


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over a histogram, equal bins handled together."""
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    rooms.setdefault(capacity - per * length, []).append((full, [length] * per))
                if rest:
                    rooms.setdefault(capacity - rest * length, []).append((1, [length] * rest))
                break
            n, items = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            take = min(n, left)
            if n > take:
                rooms.setdefault(room, []).append((n - take, items))
            rooms.setdefault(room - length, []).append((take, items + [length]))
            left -= take
    return [x for group in rooms.values() for x in group]


def _reach(sizes: list[int], number: dict[int, int], room: int) -> list[int]:
    """For each place in ``sizes``, as bits, the sums that the items from there on can have."""
    out, mask = [1], (1 << room + 1) - 1
    for size in reversed(sizes):
        bits, step, left = out[-1], 1, min(number[size], room // size)
        while left:
            step = min(step, left)
            bits |= bits << step * size & mask
            left -= step
            step *= 2
        out.append(bits)
    return out[::-1]


def _sums(one: int, several: int, size: int) -> tuple[int, int]:
    """Sums of one and of several items, as bits, with one more item."""
    return one | 1 << size, several | (one | several) << size


def _dominated(one: int, several: int, absent: int, waste: int) -> bool:
    """Whether an absent item fits where several items or smaller ones, of these sums, are."""
    bits, width = (one | several) << 1, 1
    while width < waste:
        step = min(width, waste - width)
        bits |= bits << step
        width += step
    return bool((several | bits if waste else several) & absent)


def fillings(counts: np.ndarray, room: int, most_waste: int | None = None, after: list[int] | None = None) -> Iterator[list[int]]:
    """Maximal undominated fillings of ``room``, of any number of items, lazily: least waste first, then larger items
    first. Those that waste more than ``most_waste`` are left out, and all up to ``after``.

    A filling is dominated if an item that it lacks fits in place of items that are no larger together. After
    ``PATIENCE`` dominated ones in a row dominance is not asked for, so the next filling is never far and none is lost.
    """
    number = {int(x): int(counts[x]) for x in np.flatnonzero(counts[: room + 1])[::-1]}
    if number.get(room):  # dominates all others
        if not after:
            yield [room]
        return
    least = min(number, default=room + 1)
    sizes, forced, tried = list(number), [], 0
    table = _reach(sizes, number, room)

    def choose(at: int, left: int, items: list[int], one: int, several: int, absent: int, tight: bool) -> Iterator[list[int]]:
        nonlocal tried
        if not left:
            whole = items + forced
            if not tight and not (forced and tried < PATIENCE and _dominated(one, several, absent | sum(1 << x for x in sizes[at:]), waste)):
                tried = 0
                yield whole
            return
        for j in range(at, len(sizes)):
            if not table[j] >> left & 1:
                return
            size = sizes[j]
            most, given = min(number[size], left // size), -1
            if tight and size >= after[len(items)]:
                given = after.count(size)
                most = min(most, given)
            elif tight:
                tight = False
            ways = [(one, several)]
            while len(ways) <= most:
                more = _sums(*ways[-1], size)
                if tried < PATIENCE and _dominated(*more, absent, waste):
                    tried += 1
                    break
                ways.append(more)
            for k in range(len(ways) - 1, 0, -1):
                if table[j + 1] >> left - k * size & 1:
                    yield from choose(j + 1, left - k * size, items + [size] * k, *ways[k], absent | (k < number[size]) << size, tight and k == given)
            absent |= 1 << size
            tight = tight and not given

    first = 0 if after is None else room - sum(after)
    for waste in range(first, min(room, room if most_waste is None else most_waste) + 1):
        if waste >= least and (waste == first or waste in number):  # such items would fit beside any filling, so all are in it
            forced = [x for x in number if x <= waste for _ in range(number[x])]
            sizes = [x for x in number if x > waste]
            table = _reach(sizes, number, room)
        left = room - waste - sum(forced)
        if left < 0:
            return
        if table[0] >> left & 1:
            one = several = 0
            for x in forced:
                one, several = _sums(one, several, x)
            yield from choose(0, left, [], one, several, 0, after is not None and waste == first)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: items above half need a bin each; for each threshold, the volume beside them."""
    sizes = np.arange(len(counts))
    number, volume = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]
    total = int(volume[0])
    best = -(-total // capacity)
    half = capacity // 2 + 1
    for k in range(1, capacity // 2 + 1):
        big = int(number[capacity - k + 1]) if capacity - k + 1 < len(counts) else 0
        middle = int(number[half]) - big
        room = middle * capacity - (int(volume[half]) - (int(volume[capacity - k + 1]) if big else 0))
        small = int(volume[k]) - int(volume[half])
        best = max(best, big + middle + max(0, -(-(small - room) // capacity)))
    return best


def complete_bins(counts: np.ndarray, capacity: int, node_limit: int = 1_000) -> tuple[Plan, int]:
    """A packing of the histogram and the lower bound that it is measured against."""
    counts = counts.astype(np.int64)
    bound = lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(n for n, _ in incumbent)
    total = int((counts * np.arange(len(counts))).sum())
    nodes = 0
    # A level's counts and waste, and the last filling beside its largest item with the times that it was used. Fillings
    # beside equal items come in order, so a level goes on after the one that the level before used.
    stack: list[tuple[np.ndarray, int, list[int] | None, int]] = [(counts, 0, None, 0)]
    chosen: Plan = []
    while stack and bins > bound and nodes < node_limit:
        state, wasted, items, times = stack[-1]
        del chosen[len(stack) - 1 :]
        left = np.flatnonzero(state)
        spare = (bins - 1) * capacity - total - wasted  # what a better packing may still waste
        if not len(left) or spare < 0:
            if spare >= 0:
                incumbent, bins = list(chosen), sum(n for n, _ in chosen)
            stack.pop()
            continue
        top = int(left[-1])
        rest = state.copy()
        rest[top] -= 1
        if times > 1:
            times -= 1
        else:
            items = next(fillings(rest, capacity - top, spare, items), None)
            if items is None:
                stack.pop()
                continue
            uses = np.bincount([top, *items])
            used = np.flatnonzero(uses)
            times = int((state[used] // uses[used]).min())
        waste = capacity - top - sum(items)
        times = min(times, spare // waste) if waste else times
        if times < 1:  # a level that allowed more has found a better packing since
            stack.pop()
            continue
        nodes += 1
        stack[-1] = (state, wasted, items, times)
        chosen.append((times, [top, *items]))
        after = state - times * np.bincount([top, *items], minlength=len(counts))
        stack.append((after, wasted + times * waste, items if after[top] else None, 0))
    if stack and bins > bound:  # the search hit its limit: the packing at hand is completed by best fit
        whole = chosen + best_fit(stack[-1][0], capacity)
        if sum(n for n, _ in whole) < bins:
            incumbent = whole
    return incumbent, bound


def pack(pieces: DataFrame, capacity: int = CAPACITY, node_limit: int = 1_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ids_crc32, ...) with ``sequence_id`` and ``offset``, in place of such columns if it has any.

    Other columns stay, whatever their names. ``pieces`` is read twice: give a table.
    """
    spark = pieces.sparkSession
    total = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in total:
        counts[r["length"]] = r["n"]
    plan, _ = complete_bins(counts, capacity, node_limit)
    rows, rank, base = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, items in plan:
        offset = 0
        for length in items:
            rows.append((length, int(rank[length]), int(rank[length]) + times, base, offset))
            rank[length] += times
            offset += length
        base += times
    where = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "size long, low long, high long, base long, at long")
    where = F.broadcast(where) if len(rows) <= BROADCAST_ROWS else where  # a few MB at most, else joined by length
    salts = int(min(4096, max(16, counts.sum() // 2000)))
    given = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.col("length").alias("size"), F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).alias("salt"))
    within = Window.partitionBy("size", "salt").orderBy("row.doc_id", "row.piece")
    sizes = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = sizes.select("size", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(ahead_of, ["size", "salt"]).withColumn("rank", F.col("place") + F.col("ahead"))
    placed = ranked.join(where.withColumnRenamed("size", "len"), (F.col("size") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*[F.col("row")[c].alias(c) for c in given], (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = stash(tokenize(docs), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
