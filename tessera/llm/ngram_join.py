"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersections of sorted arrays.

1. Documents travel as chunks. Of each set, the first shingles in the order of their hashes (twice a prefix, 40 % at a
   similarity of 0.8) are probed: each chunk learns how many chunks probe them too. Linked sets share at least half of
   a prefix of their probes; a document with fewer shared ones is done.
2. Documents with equal sets are one class, represented by the smallest doc_id.
3. Two linked sets share one of their rarest probes (all but those that a partner must share, less one). Representatives
   meet in tiles, named by such a shingle and a size band: bands are a factor of 1 / threshold wide, so partners are in
   the same or the next band. Tiles with the same members are one, and so are those of one hub and band whose members
   make fewer pairs together than tile by tile: copies that share many rare probes meet once, not once a probe.
4. Each tile has a hub, the member with the fewest shingles of its own, with which its other members are compared.
   Components of these links settle tiles in which all members are then connected.
5. In tiles still open, the rows outside the largest component meet all rows, in blocks. Bitmaps bound the overlap of
   members of different components from above (a bit of one that the other lacks is a shingle that the other lacks);
   only pairs whose bound reaches the threshold are intersected: first the likeliest few of each row and component, and
   then, in the tiles where others were withheld and these didn't connect the two, all the others.

No bound or cap drops a pair. Documents in one component aren't compared again, which loses no component. Joins whose
sides may both grow are sort-merge joins at every size.

Nulls, empty texts and texts without words have empty sets and link with nothing, not even each other. Repeated rows
(one doc_id) give one row each. An empty table gives no rows. Rows with a null doc_id are documents of their own, whose
ids count as larger than all others: their doc_id stays null, and so is the component_id of a component of such rows alone.
Ties among hubs go by hash. Texts of any length are whole sets; other columns are ignored by
``join`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import MESSAGES, answers_of, bucket_count, exchange, messages, rows, texts_of, to_chunks, with_answers
from tessera.llm.common import Words, discard, free_name, giving_back, stash, window_hashes
from tessera.llm.components import connected_components

SHINGLE = 5
PERCENT = 80
PART_BYTES = 4_000_000
BLOCK_ROWS = 256
BITS = 4
LIKELIEST = 2
SALTS = 8
HUB_ROWS = 256
PAIR_BYTES = 1_000_000
BASE = 0xD6E8FEB86659FD93


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles of each text."""
    words = Words(texts, lower=True)
    w = words.hashes()
    h = window_hashes(w, width, BASE)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:b].tobytes(), int(b - a))], dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first shingles (in any order that all sets share) a partner must meet."""
    return n - -(-percent * n // 100) + 1


def probe_length(n: int, percent: int) -> int:
    return min(n, 2 * prefix_length(n, percent))


def least_shared(n: int, percent: int) -> int:
    """How many probes any partner of a set of ``n`` shingles shares with it: the probes beyond a prefix, of the smallest partner.

    Of the shingles that two linked sets share, at most (size - prefix length) of either set's lie behind its prefix, so
    each probe beyond the prefix makes one more of them a probe of both; the smaller set has the fewer such probes.
    """
    m = -(-percent * n // 100)
    return probe_length(m, percent) - prefix_length(m, percent) + 1


def describe(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, part_bytes: int) -> DataFrame:
    """``(doc_id, n, own, key, chunk, body, prefix)`` of each document; ``key`` only where it may have a partner, ``body`` and
    ``prefix`` once a chunk and set. ``body`` is the text, compressed: it is smaller than its hashes."""
    chunks = to_chunks(docs, id_col, text_col, part_bytes)
    buckets = bucket_count(chunks)

    def probes(sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([s[: probe_length(len(s), percent)] if len(s) else s for s in sets])

    def ask(batches):
        for chunk, parts, _ in rows(batches):
            yield messages(chunk, np.unique(np.concatenate([np.unique(probes(shingle_sets(texts_of(p), width))) for p in parts])), buckets)

    def judge(keys: np.ndarray) -> np.ndarray:
        """For each key, 0 if one chunk alone has it, else a class that grows with the number of chunks."""
        _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        return (np.floor(np.log2(count)).astype(np.int64) + (count > 1))[at]

    grades = exchange(chunks.mapInArrow(giving_back(ask), MESSAGES), judge, "grades")

    def grade(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for chunk, parts, one in rows(batches):
            all_sets = [shingle_sets(texts_of(p), width) for p in parts]
            values, count = np.unique(np.concatenate([probes(sets) for sets in all_sets]), return_counts=True)
            far = answers_of(one, 0, len(values))
            rarity = np.where((far == 0) & (count == 1), np.uint8(0), far + np.uint8(1))
            seen = set()
            for p, sets in zip(parts, all_sets, strict=True):
                out = []
                for i, text, s in zip(p["ids"], texts_of(p), sets, strict=True):
                    n = len(s)
                    own_probes = s[: probe_length(n, percent)] if n else s
                    r = rarity[np.searchsorted(values, own_probes)]
                    shared = int((r > 0).sum())
                    if not n or shared < least_shared(n, percent):
                        out.append((i, n, None, None, chunk, None, None))
                        continue
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key in seen:
                        out.append((i, n, len(r) - shared, key, chunk, None, None))
                        continue
                    seen.add(key)
                    order = np.lexsort((own_probes, r))[len(r) - shared :]
                    out.append((i, n, len(r) - shared, key, chunk, squeeze(text), own_probes[order[: shared - least_shared(n, percent) + 1]].view(np.int64)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                for a in range(0, len(out), 512):
                    columns = zip(*out[a : a + 512], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n", "own", "key", "chunk", "body", "prefix"])

    sets = stash(with_answers(chunks, grades).mapInArrow(giving_back(grade), "doc_id long, n long, own long, key binary, chunk long, body binary, prefix array<long>"), "sets")
    discard(chunks, grades)
    return sets


def _sets_of(bodies: list[bytes], width: int, most_bytes: int = 4_000_000):
    """The sets of compressed texts, some MB of text at a time: (number, set)."""
    at = 0
    while at < len(bodies):
        texts, size = [], 0
        while at + len(texts) < len(bodies) and (not texts or size < most_bytes):
            texts.append(zstandard.ZstdDecompressor().decompress(bodies[at + len(texts)]))
            size += len(texts[-1])
        yield from enumerate(shingle_sets(texts, width), at)
        at += len(texts)


def verify(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sorted arrays reach the threshold. A set that many pairs name as ``a`` comes once for every
    ``HUB_ROWS`` of them, in keys of their own."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB_ROWS)).cast("int").alias("k"))
    spread = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")  # the numbers themselves: a hub's pairs are several keys
    each = many.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("spread", spread).hint("merge").join(each.hint("merge"), ["a", "spread"]).select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.col("k")).cast("int").alias("salt"))
    left = salted.hint("merge").join(sets.select(F.col("rep").alias("b"), F.col("body").alias("y")).hint("merge"), "b")
    hubs = many.hint("merge").join(sets.select(F.col("rep").alias("a"), F.col("body").alias("x")).hint("merge"), "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    both = left.hint("merge").join(hubs.hint("merge"), ["a", "salt"]).select("a", "b", "x", "y")
    return both.mapInArrow(giving_back(lambda batches: _linked(batches, percent, width)), "a long, b long")


def _linked(batches, percent: int, width: int):
    """``(a, b)`` of the rows ``(a, b, x, y)`` whose texts reach the threshold; rows of one ``a`` in a row share its set, and no other's is held."""
    for batch in batches:
        a, x = batch.column(0).to_numpy(), batch.column(2)
        new = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else np.empty(0, np.int64)
        heads, head = _sets_of([x[i].as_py() for i in new.tolist()], width), -1
        of = np.cumsum(np.isin(np.arange(len(a)), new)) - 1
        ok = np.zeros(len(a), bool)
        for i, t in _sets_of(batch.column(3).to_pylist(), width):
            while head < of[i]:
                head, s = next(heads)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            ok[i] = 100 * shared >= percent * (len(s) + len(t) - shared)
        mask = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def bitmap(values: np.ndarray) -> np.ndarray:
    """A hashed signature of ``BITS`` bits or more a shingle, its length a power of two, so that halves can be folded.

    Texts without shared shingles differ in most of their own at four bits already, so their bound stays far from the
    threshold; only pairs little below it pass more often than with more bits, and the exact intersection drops them.
    """
    words = 1 << int(max(0, np.ceil(np.log2(max(1, BITS * len(values) / 64)))))
    bits = np.zeros(words * 64, np.uint8)
    bits[(values >> np.uint64(20)) % np.uint64(words * 64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The signature that the same set has at a smaller length."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def with_bitmaps(sets: DataFrame, width: int) -> DataFrame:
    """``(rep, bits)`` of ``sets(rep, body)``."""

    def run(batches):
        for batch in batches:
            made = [bitmap(s).tobytes() for _, s in _sets_of(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["rep", "bits"])

    return sets.select("rep", "body").mapInArrow(giving_back(run), "rep long, bits binary")


def tile_pairs(doc: np.ndarray, n: np.ndarray, comp: np.ndarray, guest: np.ndarray, side: np.ndarray, given: list[np.ndarray], percent: int, likeliest: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of different components in a tile (or its blocks), not both guests, whose bitmaps let them reach the threshold; of each row
    and component the ``likeliest`` by that bound, or all. Last, whether any were withheld.

    ``side`` tells the rows that are compared with all others (0: this block's rows outside the largest component,
    1: another block of such, 2: the largest component's); two rows of side 1 or of side 2 are not.
    """
    own = np.flatnonzero(side == 0)
    m = ~(guest & guest[own, None]) & (comp != comp[own, None]) & ((side > 0) | (doc > doc[own, None]))
    m &= np.minimum(n, n[own, None]) * 100 >= percent * np.maximum(n, n[own, None])
    r, at = np.nonzero(m)
    if not len(r):
        return r, r, False
    r = own[r]
    words = min(map(len, given))
    bits = np.stack([fold(b, words) for b in given])
    lacks, lacked = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
    step = max(1, PAIR_BYTES // (8 * words))
    for i in range(0, len(r), step):
        x, y = bits[r[i : i + step]], bits[at[i : i + step]]
        lacks[i : i + step], lacked[i : i + step] = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x)))
    most = np.minimum(n[r] - lacks, n[at] - lacked)
    good = 100 * most >= percent * (n[r] + n[at] - most)
    r, at = r[good], at[good]
    reach = len(r)
    if likeliest is not None and len(r):
        most = most[good]
        by = np.lexsort((-most / (n[r] + n[at] - most), comp[at], r))
        new = np.ones(len(by), bool)
        new[1:] = (r[by][1:] != r[by][:-1]) | (comp[at[by]][1:] != comp[at[by]][:-1])
        heads = np.flatnonzero(new)
        by = by[np.arange(len(by)) - heads[np.cumsum(new) - 1] < likeliest]
        r, at = r[by], at[by]
    a, b = doc[r], doc[at]
    return np.minimum(a, b), np.maximum(a, b), len(r) < reach


def _tasks(batches, percent: int, likeliest: int | None):
    """``tile_pairs`` of each run of rows with the same keys; rows come sorted by them. A tile with withheld pairs gives a row of its own."""
    held = None
    for batch in _and_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        keys = np.stack([table[k].to_numpy().astype(np.int64) for k in ("token", "tile", "x", "kind", "y")])
        cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        last = len(cuts) - 1 if batch is None else len(cuts) - 2
        doc, n, comp, side = (table[c].to_numpy().astype(np.int64) for c in ("rep", "n", "comp", "side"))
        guest = table["guest"].to_numpy(zero_copy_only=False).astype(bool)
        bits = [np.frombuffer(b.as_buffer(), "<u8") for b in table["bits"]]
        found = [tile_pairs(doc[i:j], n[i:j], comp[i:j], guest[i:j], side[i:j], bits[i:j], percent, likeliest) for i, j in zip(cuts[:last].tolist(), cuts[1 : last + 1].tolist(), strict=True)]
        if found:
            pairs = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
            short = np.unique(keys[:2, cuts[:last][[f[2] for f in found]]], axis=1)
            none = lambda of, kind: pa.nulls(of.shape[1], kind)
            both = [(none(short, pa.int64()), pa.array(pairs[0], pa.int64())), (none(short, pa.int64()), pa.array(pairs[1], pa.int64())), (pa.array(short[0], pa.int64()), none(pairs, pa.int64())), (pa.array(short[1], pa.int32()), none(pairs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in both], names=["a", "b", "token", "tile"])
        held = None if batch is None else table.slice(int(cuts[-2]))


def _and_end(batches):
    yield from batches
    yield None


def open_pairs(settled: DataFrame, bitmaps: DataFrame, percent: int, block_rows: int, likeliest: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of different components that meet in a tile and may reach the threshold, and ``(token, tile)`` of the
    tiles that withheld some.

    In each tile that holds several components, rows outside the largest one (strays) are dealt into blocks; each block
    meets itself, every later block of strays, and every block of the largest component. So a component's rows
    are repeated only as often as there are blocks of strays, and a tile with few strays costs little.
    """
    tile = ["token", "tile"]
    sizes = settled.groupBy(*tile, "comp").agg(F.count(F.lit(1)).alias("m"))
    shape = sizes.groupBy(*tile).agg(F.max("m").alias("top"), F.max_by("comp", "m").alias("main"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = shape.select(*tile, "main", F.ceil((F.col("all") - F.col("top")) / F.lit(block_rows)).cast("int").alias("k"), F.ceil(F.col("top") / F.lit(block_rows)).cast("int").alias("j"))
    stray = F.col("comp") != F.col("main")
    block = F.pmod(F.xxhash64("rep"), F.when(stray, F.col("k")).otherwise(F.col("j"))).cast("int")
    # Tasks by kind: 0 has strays of block x, 1 those of blocks x and y, 2 those of block x and block y of the largest component.
    dealt = _at_tiles(settled, blocks).withColumn("block", block)
    met_by = F.when(
        stray,
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least("block", o).alias("x"), (F.col("block") != o).cast("int").alias("kind"), F.greatest("block", o).alias("y"), (F.col("block") > o).cast("int").alias("side"))),
            F.transform(F.sequence(F.lit(0), F.col("j") - 1), lambda o: F.struct(F.col("block").alias("x"), F.lit(2).alias("kind"), o.alias("y"), F.lit(0).alias("side"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(o.alias("x"), F.lit(2).alias("kind"), F.col("block").alias("y"), F.lit(2).alias("side"))))
    met = dealt.select(*tile, "guest", "rep", "n", "comp", F.inline(met_by))
    marked = met.hint("merge").join(bitmaps.hint("merge"), "rep")
    task = [*tile, "x", "kind", "y"]
    return marked.repartition(*task).sortWithinPartitions(*task).mapInArrow(giving_back(lambda batches: _tasks(batches, percent, likeliest)), "a long, b long, token long, tile int").distinct()


def with_ids(docs: DataFrame, id_col: str) -> tuple[DataFrame, int | None]:
    """``docs`` with null ids replaced by numbers above all others, and the largest id that was given (None: no null ids).

    The replaced rows are written once, so their numbers stay.
    """
    given = F.col(id_col).cast("long")
    count, ids, top = docs.agg(F.count(F.lit(1)), F.count(given), F.max(given)).first()
    if count == ids:
        return docs, None
    top = -1 if top is None else max(top, -1)
    nameless = stash(docs.filter(given.isNull()).select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "nameless")
    part = F.shiftright("at", 33)
    ahead = nameless.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a partition
    place = F.lit(top + 1) + F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = nameless.withColumn("part", part).join(ahead, "part").select(*[place.alias(c) if c == id_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return docs.filter(given.isNotNull()).withColumn(id_col, given).select(*[f"`{c}`" for c in docs.columns]).unionByName(numbered), top


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, part_bytes: int = PART_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document ``(doc_id, n_shingles, component_id)``: components of the links that reach the threshold."""
    numbered, top = with_ids(docs, id_col)
    out = _join(numbered, id_col, text_col, width, percent, part_bytes, block_rows)
    return out if top is None else out.select(*[F.when(F.col(c) <= top, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns])


def _at_tiles(rows: DataFrame, tiles: DataFrame, key: tuple[str, str] = ("token", "tile")) -> DataFrame:
    """``rows`` with the columns of their tile. A tile's rows are dealt by some salts, so one that many rows share isn't one key."""
    each = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).hint("merge").join(each.hint("merge"), [*key, "salt"]).drop("salt")


def _tiles(reps: DataFrame, percent: int) -> DataFrame:
    """``(token, tile, guest, rep, n, hub, hub_n)``: the tiles of two members or more, one of those with the same members, and
    one of a hub's where their union makes no more pairs than they do one by one."""
    tile = ["token", "tile"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    meets = reps.select("rep", "n", "own", F.explode("prefix").alias("token"), band.alias("b"))
    both = F.explode(F.array(F.struct(F.col("b").alias("tile"), F.lit(False).alias("guest")), F.struct((F.col("b") + 1).alias("tile"), F.lit(True).alias("guest"))))
    tiles = meets.select("token", "rep", "n", "own", both.alias("t")).select("token", "t.tile", "t.guest", "rep", "n", "own")
    # Only aggregates of fixed width: they stay in hash tables. The hub is the smallest by ``own``, then by hash.
    seed, rank = lambda i: F.xxhash64("rep", "guest", F.lit(i)), F.shiftleft("own", 32) + F.shiftrightunsigned(F.xxhash64("rep"), 32)
    members = tiles.groupBy(*tile).agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(seed(1)).alias("h1"), F.bit_xor(seed(2)).alias("h2"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min("guest").alias("idle"), F.min_by("rep", rank).alias("hub"), F.min_by("n", rank).alias("hub_n")
    )
    hubs = members.filter("lo < hi and not idle").groupBy("tile", "m", "h1", "h2").agg(F.min("token").alias("token"), F.min_by("hub", "token").alias("hub"), F.min_by("hub_n", "token").alias("hub_n"))
    columns, kin = [*tile, "guest", "rep", "n", "hub", "hub_n"], ("tile", "hub")
    apart = stash(_at_tiles(tiles, hubs.select(*tile, "hub", "hub_n")).select(*columns), "apart")
    pairs = apart.groupBy(*tile, "hub").agg(F.count(F.lit(1)).alias("m")).groupBy(*kin).agg(F.min("token").alias("first"), F.sum(F.col("m") * F.col("m")).alias("pairs"))
    union = apart.select(*kin, "rep").distinct().groupBy(*kin).agg(F.count(F.lit(1)).alias("u"))
    shared = pairs.hint("merge").join(union.hint("merge"), [*kin]).select(*kin, F.when(F.col("u") * F.col("u") <= F.col("pairs"), F.col("first")).alias("first"))
    one = stash(_at_tiles(apart, shared, kin).withColumn("token", F.coalesce("first", "token")).select(*columns).distinct(), "tiles")
    discard(apart)
    return one


def _named(rows: DataFrame, comps: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the component of the node in ``col``."""
    found = comps.select(F.col("node").alias(col), F.col("component").alias("found"))
    return rows.hint("merge").join(found.hint("merge"), col, "left").withColumn(name, F.coalesce("found", col)).drop("found")


def _join(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, percent: int = PERCENT, part_bytes: int = PART_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    described = describe(docs, id_col, text_col, width, percent, part_bytes)
    maybe = described.filter("key is not null")
    classes = stash(maybe.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("body").isNotNull(), F.col("chunk"))).alias("chunk")), "classes")
    reps = stash(maybe.filter("body is not null").select("key", "chunk", "n", "own", "prefix", "body").hint("merge").join(classes.hint("merge"), ["key", "chunk"]).select("rep", "n", "own", "prefix", "body"), "reps")
    tiles = _tiles(reps, percent)
    bodies = reps.select("rep", "body")

    compatible = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    tried = stash(tiles.filter((F.col("rep") != F.col("hub")) & compatible).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "spokes")
    links = stash(verify(tried, bodies, percent, width), "links")
    comps = connected_components(links)
    spokes, bitmaps = tried, stash(with_bitmaps(bodies, width), "bitmaps")
    left = tiles.select("token", "tile", "guest", "rep", "n")
    for likeliest in (LIKELIEST, None):
        met = stash(open_pairs(_named(left, comps, "rep", "comp"), bitmaps, percent, block_rows, likeliest), "met")
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = stash(met.filter("a is not null").select("a", "b").hint("merge").join(known.hint("merge"), ["a", "b"], "left_anti"), "more")
        # All pairs of the other tiles are in ``more`` or were tried before: only tiles with withheld pairs have any left.
        withheld = met.filter("token is not null").select("token", "tile").distinct()
        left = _at_tiles(left, withheld)
        if not more.isEmpty():
            new, tried = stash(verify(more, bodies, percent, width), "links"), tried.unionByName(more)
            if not new.isEmpty():
                links = links.unionByName(new)
                comps = connected_components(links)
        if withheld.isEmpty():
            break
    discard(tiles, reps, spokes, bitmaps)
    by_class = _named(classes.select("key", "rep"), comps, "rep", "component_id").select("key", "component_id")
    linked = maybe.select("doc_id", "n", "key").hint("merge").join(by_class.hint("merge"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return described.filter("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).unionByName(linked)


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; one with a null id only where none has an id. Rows that repeat
    a kept doc_id stay. The columns of ``docs`` stay, whatever their names."""
    numbered, top = with_ids(docs, "doc_id")
    name = free_name(docs, "first_id")
    first = _join(numbered, "doc_id", "text").filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = numbered.join(first, F.col("doc_id") == F.col(name), "left_semi")
    return kept if top is None else kept.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")).cast(docs.schema["doc_id"].dataType))
