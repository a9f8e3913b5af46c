"""Language identification with a bidirectional gated recurrent network over bytes, trained in numpy.

The network labels every byte position of a window from a forward and a backward state; a document's probabilities
are the mean over all its positions. Training is backpropagation through time with Adam on a bounded sample: at most
``TRAIN_DOCS`` documents a language (the smallest hashes of doc_id) and ``WINDOWS_A_DOC`` windows of each, spread over
the whole text. Prediction reads whole texts, in windows of ``WINDOW`` bytes side by side; states start at zero in each.

Texts that are null or have no letter get ``und`` and score 0. Without any labelled document every text does. Repeated
rows give equal rows. Only text and lang of the training rows are learnt from; only text is predicted from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = 8
WINDOW = 128
TRAIN_WINDOW = 64
TRAIN_DOCS = 300
WINDOWS_A_DOC = 4
STEPS = 240
BATCH = 192
RATE = 0.02
SIDE_BY_SIDE = 2048
_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += _F(1)
    return np.reciprocal(x, out=x)


def init(classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of both directions (first axis); gates in the order reset, update, candidate."""
    rng = np.random.default_rng(seed)
    return {
        "x": (rng.standard_normal((2, 256, 3 * hidden)) * 0.3).astype(_F),
        "u": (rng.standard_normal((2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(_F),
        "o": (rng.standard_normal((2, hidden, classes)) * 0.3).astype(_F),
        "b": np.zeros(classes, dtype=_F),
    }


def states(w: dict[str, np.ndarray], d: int, window: np.ndarray, mask: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
    """States (time, row, hidden) of one direction over byte windows (row, time). Masked bytes keep the state."""
    n, length = window.shape
    hidden = w["u"].shape[1]
    h = np.zeros((n, hidden), dtype=_F)
    out = np.empty((length, n, hidden), dtype=_F)
    u_gates, u_new = np.ascontiguousarray(w["u"][d][:, : 2 * hidden]), np.ascontiguousarray(w["u"][d][:, 2 * hidden :])
    columns = np.ascontiguousarray(window.T)
    for t in range(length) if d == 0 else range(length - 1, -1, -1):
        x = w["x"][d].take(columns[t], axis=0)
        gates = h @ u_gates
        gates += x[:, : 2 * hidden]
        gates = _sigmoid(gates)
        r, z = gates[:, :hidden], gates[:, hidden:]
        new = (r * h) @ u_new
        new += x[:, 2 * hidden :]
        np.tanh(new, out=new)
        after = new + z * (h - new)
        if mask is not None and not mask[:, t].all():
            after = np.where(mask[:, t][:, None], after, h)
        if tape is not None:
            tape.append((t, h, r, z, new))
        out[t] = h = after
    return out


def probabilities(w: dict[str, np.ndarray], window: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Class probabilities of every position: (time, row, class)."""
    logits = states(w, 0, window, mask) @ w["o"][0]
    logits += states(w, 1, window, mask) @ w["o"][1]
    logits += w["b"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(w: dict[str, np.ndarray], window: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions and its gradient, by backpropagation through time."""
    n, length = window.shape
    hidden = w["u"].shape[1]
    tapes: list[list] = [[], []]
    h = [states(w, d, window, None, tapes[d]) for d in (0, 1)]
    logits = h[0] @ w["o"][0] + h[1] @ w["o"][1] + w["b"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    loss = float(-np.log(p[:, np.arange(n), label] + 1e-12).mean())
    p[:, np.arange(n), label] -= 1
    p /= n * length
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["b"] = p.sum(axis=(0, 1))
    for d in (0, 1):
        g["o"][d] = np.einsum("tnh,tnc->hc", h[d], p)
        u = w["u"][d]
        back = np.zeros((n, hidden), dtype=_F)
        for t, before, r, z, new in reversed(tapes[d]):
            dh = back + p[t] @ w["o"][d].T
            dz = dh * (before - new) * z * (1 - z)
            dnew = dh * (1 - z) * (1 - new * new)
            drh = dnew @ u[:, 2 * hidden :].T
            dr = drh * before * r * (1 - r)
            gate = np.concatenate((dr, dz), axis=1)
            back = dh * z + drh * r + gate @ u[:, : 2 * hidden].T
            g["u"][d][:, : 2 * hidden] += before.T @ gate
            g["u"][d][:, 2 * hidden :] += (r * before).T @ dnew
            np.add.at(g["x"][d], window[:, t], np.concatenate((gate, dnew), axis=1))
    return loss, g


def train(texts: list[str], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the network to labelled texts."""
    rng = np.random.default_rng(seed)
    windows, targets = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if not len(raw):
            continue
        for start in np.linspace(0, max(0, len(raw) - TRAIN_WINDOW), WINDOWS_A_DOC).astype(int):
            part = raw[start : start + TRAIN_WINDOW]
            windows.append(np.resize(part, TRAIN_WINDOW))
            targets.append(label)
    w = init(classes, seed=seed)
    if not windows or classes < 2:
        return w
    x, y = np.stack(windows), np.array(targets)
    by_class = [np.flatnonzero(y == c) for c in range(classes)]
    by_class = [c for c in by_class if len(c)]
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(c, max(1, BATCH // len(by_class))) for c in by_class])
        _, g = gradients(w, x[rows], y[rows])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
        for k in w:
            d = g[k] * _F(min(1.0, 1.0 / (norm + 1e-9)))
            first[k] = _F(0.9) * first[k] + _F(0.1) * d
            second[k] = _F(0.99) * second[k] + _F(0.01) * d * d
            w[k] -= _F(rate) * (first[k] / _F(1 - 0.9**step)) / (np.sqrt(second[k] / _F(1 - 0.99**step)) + _F(1e-7))
    return w


def pool(w: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all positions of each text; empty texts get zeros."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros((len(texts), len(w["b"])))
    rows = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), dtype=np.uint8).reshape(-1, WINDOW)
    size = np.full(len(rows), WINDOW)
    ends = np.cumsum(counts)
    for t, e, c in zip(texts, ends, counts, strict=True):
        if c:
            size[e - 1] = len(t) - (c - 1) * WINDOW
    order = np.argsort(-size, kind="stable")  # whole windows first: they need no mask
    for a in range(0, len(rows), SIDE_BY_SIDE):
        at = order[a : a + SIDE_BY_SIDE]
        if size[at[-1]] == WINDOW:
            sums = probabilities(w, rows[at]).sum(axis=0)
        else:
            mask = np.arange(WINDOW) < size[at][:, None]
            sums = np.einsum("tnc,nt->nc", probabilities(w, rows[at], mask), mask.astype(_F))
        np.add.at(total, owner[at], sums)
    return total / np.maximum([[len(t)] for t in texts], 1) if texts else total


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights learnt from the rows that aren't held out. Languages are few: one small query each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = sorted(r[0] for r in docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull()).groupBy("lang").count().collect())
    keyed = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("id")))
    picked = None
    for lang in langs:
        own = keyed.filter(F.col("lang") == lang).orderBy(F.xxhash64("id"), "id").limit(train_docs).select("id")
        picked = own if picked is None else picked.unionByName(own)
    if picked is None:
        return [], init(1)
    sample = rows.join(F.broadcast(picked.distinct()), "id", "left_semi").orderBy("id").select("text", "lang").toPandas()
    return langs, train(sample["text"].tolist(), [langs.index(x) for x in sample["lang"]], len(langs))


def predict(docs: DataFrame, langs: list[str], weights: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (not texts or size < 1_000_000):
                    text = batch.column(1)[at + len(texts)].as_py() or ""
                    texts.append(text if langs and any(map(str.isalpha, text)) else "")
                    size += len(texts[-1])
                pooled = pool(weights, [t.encode("utf-8") for t in texts])
                best = pooled.argmax(axis=1)
                known = [bool(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + len(texts)], pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()), pa.array([min(1.0, float(p[b])) if k else 0.0 for p, b, k in zip(pooled, best, known, strict=True)], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )
                at += len(texts)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, weights = fit(docs)
    return predict(docs, langs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
