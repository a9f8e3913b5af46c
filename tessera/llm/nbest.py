"""SentencePiece encoding and decoding with exact N-best segmentation.

A text becomes units between which no piece can reach (a run of spaces and what follows it; line feeds alone). The
piece lattice of a unit gets forward Viterbi scores; they are the exact heuristic of a backward A-star search, which
therefore yields segmentations in order, best first. A batch's unseen units are scored side by side. The second best
score of a unit (the best path through an edge off the best path) tells which units can deviate in a text's N best
segmentations: only those are searched.

Scores are integers (millionths of a nat): the model's own score s of a piece, which in a BPE model is minus its rank,
becomes -ln(1 - s), a Zipfian unigram weight. A character without a piece is spelt in byte pieces, at the worst score
less 10 nats. Ties: the smaller last differing piece id wins within a unit; between texts' segmentations the later
units' ranks are compared first. All arithmetic is exact.

Null and empty texts have no pieces, and one segmentation. Repeated rows give equal rows. An empty table gives no rows. A text
without any space is one unit; time and memory grow with its length alone. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from functools import cmp_to_key
from itertools import product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NBEST = 4
CACHE_UNITS = 300_000
SIDE_BY_SIDE_LENGTH = 24
_NONE = -(1 << 60)
_estimate = itemgetter(0)
_UNITS = re.compile("\n| *[^ \n]+| +")
_ENCODERS: dict[tuple[str, int], Encoder] = {}
_BATCH_CHARS = 3_000_000
_HASH = np.uint64(0x9E3779B97F4A7C15)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Paths:
    """Paths as chains of parents, each with one pointer far up, so that two are compared in logarithmic time."""

    def __init__(self):
        self.parent, self.edge, self.depth, self.jump = [0], [0], [0], [0]

    def add(self, parent: int, edge: int) -> int:
        far = self.jump[parent]
        level = self.depth[parent] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]]
        for column, value in ((self.parent, parent), (self.edge, edge), (self.depth, self.depth[parent] + 1), (self.jump, self.jump[far] if level else parent)):
            column.append(value)
        return len(self.edge) - 1

    def edges(self, path: int) -> list[int]:
        """The edges from the last one added to the first: a path runs from a unit's end to its start."""
        out = []
        while path:
            out.append(self.edge[path])
            path = self.parent[path]
        return out

    def before(self, x: int, y: int) -> bool:
        """Whether path x comes before path y, edge by edge from the first one added; of two where one goes on, the shorter does."""
        dx, dy = self.depth[x], self.depth[y]
        for one in ("x", "y"):
            node, depth = (x, dy) if one == "x" else (y, dx)
            while self.depth[node] > depth:
                node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
            x, y = (node, y) if one == "x" else (x, node)
        if x == y:
            return dx < dy
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.edge[x] < self.edge[y]


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.surface: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.surface[i] = bytes([int(text[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = text.replace("▁", " ")
                self.pieces[text] = (i, -int(round(np.log1p(-min(0.0, sp.get_score(i))) * 1e6)))
                self.surface[i] = text.encode("utf-8")
        self.size = sp.get_piece_size()
        if any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("pieces of this model reach across units")
        self.longest = max(map(len, self.pieces))
        self.fallback = min(s for _, s in self.pieces.values()) - 10_000_000
        # every prefix of a piece by its hash, with the piece's id (or -1) and score: a lookup also tells whether to go on
        prefixes = dict.fromkeys(p[:n] for p in self.pieces for n in range(1, len(p) + 1))
        keys = np.array([self._hash(p) for p in prefixes], dtype=np.uint64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.key_ids = np.array([self.pieces.get(p, (-1, 0))[0] for p in prefixes], dtype=np.int64)[by]
        self.key_scores = np.array([self.pieces.get(p, (-1, _NONE))[1] for p in prefixes], dtype=np.int64)[by]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def spell(self, edge: int) -> list[int]:
        """The ids of an edge: a piece, or the byte pieces of a character (edges from ``size`` up)."""
        return [edge] if edge < self.size else [self.byte_ids[b] for b in chr(edge - self.size).encode("utf-8")]

    def edges(self, unit: str) -> list[list[tuple[int, int, int]]]:
        """Per end position, the edges (start, edge, score) of a unit's lattice."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(unit) + 1)]
        for i in range(len(unit)):
            for j in range(i + 1, min(len(unit), i + self.longest) + 1):
                if p := self.pieces.get(unit[i:j]):
                    out[j].append((i, *p))
            if unit[i] not in self.pieces:
                out[i + 1].append((i, self.size + ord(unit[i]), self.fallback))
        return out

    def search(self, unit: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a unit as (score, edges): backward A-star on forward Viterbi scores.

        The heuristic is exact, so each open path has a completion of its own at its estimate: only the n first can matter,
        and the open list never holds more. Paths are chains of parents; the work grows with the unit's length.
        """
        edges = self.edges(unit)
        forward = [0] + [_NONE] * len(unit)
        for j in range(1, len(unit) + 1):
            forward[j] = max(forward[i] + s for i, _, s in edges[j])
        paths = _Paths()
        opened = [(-forward[-1], 0, len(unit), 0)]  # estimate, path, position, score so far
        found = []
        while opened and len(found) < n:
            f, path, at, g = opened.pop(0)
            if at == 0:
                found.append((-f, paths.edges(path)))
                continue
            more = opened + [(-(g + s + forward[i]), (path, edge), i, g + s) for i, edge, s in edges[at]]
            if len(more) > 1:
                more.sort(key=_estimate)
                keep = min(len(more), n - len(found))
                worst = more[keep - 1][0]
                while len(more) > keep and more[-1][0] > worst:
                    more.pop()
            opened = [x if type(x[1]) is int else (x[0], paths.add(*x[1]), *x[2:]) for x in more]
            if any(x[0] == y[0] for x, y in zip(opened, opened[1:], strict=False)):
                opened.sort(key=cmp_to_key(lambda x, y: -1 if x[0] < y[0] or (x[0] == y[0] and paths.before(x[1], y[1])) else 1))
                del opened[n - len(found) :]
        return found

    def score_one(self, unit: str) -> tuple[list[int], int, int]:
        """(edges of the best segmentation, its score, the second best score) of a unit of any length, in time that grows with it."""
        edges, length = self.edges(unit), len(unit)
        forward, back = [0] + [_NONE] * length, [_NONE] * length + [0]
        for j in range(1, length + 1):
            forward[j] = max(forward[i] + s for i, _, s in edges[j])
        for j in range(length, 0, -1):
            for i, _, s in edges[j]:
                back[i] = max(back[i], s + back[j])
        at, path, on = length, [], set()
        while at:
            edge, start = min((edge, i) for i, edge, s in edges[at] if forward[i] + s == forward[at])
            path.append(edge)
            on.add((start, at))
            at = start
        second = max((forward[i] + s + back[j] for j in range(1, length + 1) for i, _, s in edges[j] if (i, j) not in on), default=_NONE)
        return path[::-1], forward[length], second if second > _NONE // 2 else _NONE

    def score_units(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(units in another order, ids of their best segmentations on end, how many each has, best and second best
        scores), those of one length side by side. ``_NONE`` where there is no second segmentation."""
        groups: dict[int, list[str]] = {}
        for u in units:
            groups.setdefault(len(u), []).append(u)
        parts = [self._score_long(g) if length > SIDE_BY_SIDE_LENGTH else self._score_group(g, length) for length, g in groups.items()]
        return [u for g in groups.values() for u in g], *(np.concatenate([p[i] for p in parts]) for i in range(4))

    def _spell_all(self, paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        spelt = [[i for e in edges for i in self.spell(e)] for edges in paths]
        return np.array([i for s in spelt for i in s], dtype=np.int64), np.array([len(s) for s in spelt], dtype=np.int64)

    def _score_long(self, units: list[str]):
        two = [self.score_one(u) for u in units]
        return *self._spell_all([t[0] for t in two]), np.array([t[1] for t in two], dtype=np.int64), np.array([t[2] for t in two], dtype=np.int64)

    def _score_group(self, units: list[str], length: int):
        n = len(units)
        cp = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).reshape(n, length).T.astype(np.uint64)
        into: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        for i in range(length):
            rows, h = None, np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = (h + (cp[j - 1] if rows is None else cp[j - 1][rows]) + np.uint64(1)) * _HASH
                h ^= h >> np.uint64(29)
                p = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[p] == h
                ids, scores = self.key_ids[p], self.key_scores[p]
                good = hit & (ids >= 0)
                if j == i + 1:
                    into[j].append((i, np.where(good, ids, self.size + cp[i].astype(np.int64)), np.where(good, scores, self.fallback)))
                elif good.any():
                    if rows is None:
                        into[j].append((i, ids, np.where(good, scores, _NONE)))
                    else:
                        all_ids, all_scores = np.zeros(n, dtype=np.int64), np.full(n, _NONE, dtype=np.int64)
                        all_ids[rows], all_scores[rows] = ids, np.where(good, scores, _NONE)
                        into[j].append((i, all_ids, all_scores))
                if not hit.all():  # go on only where a piece may begin so
                    rows, h = (np.flatnonzero(hit) if rows is None else rows[hit]), h[hit]
                    if not len(rows):
                        break
        forward = [np.zeros(n, dtype=np.int64)]
        for j in range(1, length + 1):
            best = forward[into[j][0][0]] + into[j][0][2]
            for i, _, s in into[j][1:]:
                np.maximum(best, forward[i] + s, out=best)
            forward.append(best)
        back = [np.full(n, _NONE, dtype=np.int64) for _ in range(length)] + [np.zeros(n, dtype=np.int64)]
        for j in range(length, 0, -1):
            for i, _, s in into[j]:
                np.maximum(back[i], s + back[j], out=back[i])
        # walk back along the best path, the smallest id among equals; edges off it give the second best score
        pos, taken, second = np.full(n, length), [], np.full(n, _NONE, dtype=np.int64)
        for j in range(length, 0, -1):
            here = pos == j
            low, start = np.full(n, 1 << 40), np.zeros(n, dtype=np.int64)
            for i, ids, s in into[j]:
                better = (forward[i] + s == forward[j]) & (ids < low)
                low, start = np.where(better, ids, low), np.where(better, i, start)
            for i, _, s in into[j]:
                through = forward[i] + s + back[j]
                np.maximum(second, np.where(here & (start == i), _NONE, through), out=second)
            taken.append(np.where(here, low, -1))
            pos = np.where(here, start, pos)
        paths = np.stack(taken[::-1], axis=1)
        used = paths >= 0
        flat, sizes = paths[used], used.sum(axis=1)
        if (flat >= self.size).any():
            flat, sizes = self._spell_all([[x for x in row if x >= 0] for row in paths.tolist()])
        return flat, sizes, forward[length], np.where(second > _NONE // 2, second, _NONE)

    def decode(self, ids) -> str:
        """The text of piece ids, without the space that encoding puts first."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Encoder:
    """N-best encoding of whole texts with a cache of units, which is emptied when full (no result depends on it)."""

    def __init__(self, path: str, n: int = NBEST, limit: int = CACHE_UNITS):
        self.model, self.n, self.limit = Model(path), n, limit
        self._clear()

    @classmethod
    def of_worker(cls, path: str, n: int) -> Encoder:
        """The encoder of this Python worker: its cache outlives a task."""
        if (path, n) not in _ENCODERS:
            _ENCODERS[path, n] = cls(path, n)
        return _ENCODERS[path, n]

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.searched: dict[str, list[tuple[int, list[int]]]] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.best, self.regret = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        if len(self.index) > self.limit:
            self._clear()
        new = [u for u in dict.fromkeys(units) if u not in self.index]
        if not new:
            return
        ordered, ids, sizes, best, second = self.model.score_units(new)
        self.index.update(zip(ordered, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.best = np.concatenate((self.best, best))
        self.regret = np.concatenate((self.regret, np.where(second > _NONE, best - second, 1 << 59)))

    def encode(self, texts: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """The N best (score, ids) of each text."""
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        self._learn([u for units in split for u in units])
        out = []
        for units in split:
            at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            ids = self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
            total = int(self.best[at].sum())
            regret = self.regret[at]
            pick = np.argsort(regret, kind="stable")[: self.n - 1] if self.n > 1 else []
            pick = sorted(int(p) for p in pick if regret[p] < 1 << 59)
            options = []
            for p in pick:
                if units[p] not in self.searched:
                    self.searched[units[p]] = self.model.search(units[p], self.n)
                options.append(self.searched[units[p]])
            ranked = sorted((sum(o[0][0] - o[r][0] for o, r in zip(options, ranks, strict=True)), ranks[::-1]) for ranks in product(*(range(len(o)) for o in options)))[: self.n]
            found = []
            for lost, ranks in ranked:
                own = ids
                for p, o, r in sorted(zip(pick, options, ranks[::-1], strict=True), key=lambda x: x[0], reverse=True):
                    if r:
                        new = [i for e in o[r][1] for i in self.model.spell(e)]
                        own = np.concatenate((own[: ends[p] - sizes[p]], np.array(new, np.int32), own[ends[p] :]))
                found.append((total - lost, own))
            out.append(found)
        return out


ENCODED = "doc_id {id}, n_pieces long, score long, ids_crc32 long, nbest_scores array<long>, nbest_ids_crc32 array<long>, round_trip boolean"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each text's best segmentation, the scores and checksums of its N best, and whether decoding gives the text back.
    ``with_ids`` adds ``ids``, the best segmentation."""
    path = path or model_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = ENCODED.format(id=source.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def run(batches):
        encoder = Encoder.of_worker(path, n)
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                texts, size = [], 0
                while a + len(texts) < batch.num_rows and (not texts or size < _BATCH_CHARS):
                    texts.append(batch.column(1)[a + len(texts)].as_py() or "")
                    size += len(texts[-1])
                part = batch.slice(a, len(texts))
                a += len(texts)
                coded = encoder.encode(texts)
                arrays = [
                    part.column(0),
                    pa.array([len(c[0][1]) for c in coded], pa.int64()),
                    pa.array([c[0][0] for c in coded], pa.int64()),
                    pa.array([crc(c[0][1]) for c in coded], pa.int64()),
                    pa.array([[s for s, _ in c] for c in coded], pa.list_(pa.int64())),
                    pa.array([[crc(i) for _, i in c] for c in coded], pa.list_(pa.int64())),
                    pa.array([encoder.model.decode(c[0][1].tolist()) == t for c, t in zip(coded, texts, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_ids_crc32", "round_trip"]
                if with_ids:
                    arrays.append(pa.array([c[0][1] for c in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from piece ids; null ids give null."""
    path = path or model_path()
    source = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        model = Model(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
