"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

Texts are read in windows of ``WINDOW`` bytes. In each, one GRU runs from the left and one from the right; every position
gets label probabilities from both states there, and a document's are the mean over all its positions. Training is
backpropagation through time on windows of a bounded sample of documents, on the driver; the model (some 20 kB) goes to the
executors, where whole texts are read in blocks of windows of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import held_out, small_batches

WINDOW, HIDDEN = 64, 8
#: The training sample: documents of each language about, documents in all at most, windows of each.
PER_LANGUAGE, SAMPLE, WINDOWS_EACH = 400, 4_000, 6
STEPS, BATCH, RATE = 200, 96, 0.03
#: Windows that are read at once.
BLOCK = 4_096
FOLDS, TEST_FOLD = 3, 1
UNKNOWN = "und"


@dataclass
class Model:
    """x: (2, 256, 3H) inputs by byte, u: (2, H, 3H) recurrence (update, reset, candidate), v: (2H, L), c: (L,)."""

    labels: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.c]


def _new(labels: list[str], rng: np.random.Generator) -> Model:
    h = HIDDEN
    f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    x = f(2, 256, 3 * h, scale=0.3)
    x[:, :, :h] += 1.0  # at first the state is mostly kept
    return Model(labels, x, f(2, h, 3 * h, scale=0.3), f(2 * h, len(labels), scale=0.3), np.zeros(len(labels), np.float32))


def _gate(a: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * a + 0.5, 0, 1)


def _states(m: Model, data: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of both directions, (2, T, B, H), for bytes (B, T); masked positions have state zero. ``keep`` gets what the
    way back needs."""
    b, t = data.shape
    h = HIDDEN
    both = np.stack([data.T, data.T[::-1]])
    masks = np.stack([mask.T, mask.T[::-1]]).astype(np.float32)[..., None]
    out = np.zeros((2, t, b, h), np.float32)
    state = np.zeros((2, b, h), np.float32)
    side = np.arange(2)[:, None]
    for k in range(t):
        g, r = m.x[side, both[:, k]], state @ m.u
        zr = _gate(g[..., : 2 * h] + r[..., : 2 * h])
        z, reset = zr[..., :h], zr[..., h:]
        n = np.tanh(g[..., 2 * h :] + reset * r[..., 2 * h :])
        new = (n + z * (state - n)) * masks[:, k]
        if keep is not None:
            keep.append((state, z, reset, n, r[..., 2 * h :], masks[:, k]))
        out[:, k] = state = new
    out[1] = out[1, ::-1]
    return out


def _step(m: Model, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of a batch: cross entropy at every position, backpropagated through time."""
    b, t = data.shape
    h = HIDDEN
    keep: list = []
    states = _states(m, data, mask, keep)
    both = np.concatenate([states[0], states[1]], axis=-1)
    logits = both @ m.v + m.c
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    weight = mask.T / mask.sum()
    loss = -float((np.log(np.maximum(np.take_along_axis(p, label[None, :, None], -1)[..., 0], 1e-9)) * weight).sum())
    d = p.copy()
    d[:, np.arange(b), label] -= 1
    d *= weight[..., None]
    flat = d.reshape(-1, d.shape[-1])
    dv, dc = both.reshape(-1, 2 * h).T @ flat, flat.sum(0)
    dboth = d @ m.v.T
    dout = np.stack([dboth[..., :h], dboth[::-1, :, h:]])
    du, dg = np.zeros_like(m.u), np.zeros((2, t, b, 3 * h), np.float32)
    dh = np.zeros((2, b, h), np.float32)
    ut = m.u.transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        state, z, reset, n, r, on = keep[k]
        dh = (dh + dout[:, k]) * on
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (state - n) * 0.25 * ((z > 0) & (z < 1))
        dr = dn * r * 0.25 * ((reset > 0) & (reset < 1))
        grad = np.concatenate([dz, dr, dn * reset], -1)
        dg[:, k] = np.concatenate([dz, dr, dn], -1)
        du += state.transpose(0, 2, 1) @ grad
        dh = dh * z + grad @ ut
    hot = np.zeros((t * b, 256), np.float32)
    hot[np.arange(t * b), data.T.reshape(-1)] = 1
    dg[1] = dg[1, ::-1]
    dx = hot.T @ dg.reshape(2, t * b, 3 * h)
    return loss, [dx, du, dv, dc]


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of all texts, one after the other, start, how long they are and which text they are of; an
    empty text has none."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    n = -(-size // WINDOW)
    which = np.repeat(np.arange(len(texts)), n)
    inside = WINDOW * (np.arange(len(which)) - (np.cumsum(n) - n)[which])
    return (np.cumsum(size) - size)[which] + inside, np.minimum(WINDOW, size[which] - inside), which


def laid_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (N, WINDOW) and mask of some windows; zeros where a window is shorter."""
    at = np.arange(WINDOW)
    mask = at < length[:, None]
    return np.where(mask, data[np.minimum(start[:, None] + at, max(len(data) - 1, 0))], 0).astype(np.uint8), mask


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (N, WINDOW), mask and text number of the windows of all texts: for samples, a text is read in blocks."""
    start, length, which = cut(texts)
    if not len(which):
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), bool), which
    return *laid_out(np.frombuffer(b"".join(texts), np.uint8), start, length), which


def train(samples: list[tuple[str, list[bytes]]], seed: int = 7) -> Model:
    """A model for the labels of (label, pieces of text)."""
    labels = sorted({label for label, _ in samples})
    rng = np.random.default_rng(seed)
    m = _new(labels, rng)
    pieces = [(labels.index(label), p[:WINDOW]) for label, own in samples for p in own if p]
    if len(labels) < 2 or not pieces:
        return m
    truth = np.array([a for a, _ in pieces])
    data, mask, _ = windows([p for _, p in pieces])
    by_label = [np.flatnonzero(truth == k) for k in range(len(labels)) if (truth == k).any()]
    first, second = [np.zeros_like(w) for w in m.weights], [np.zeros_like(w) for w in m.weights]
    for step in range(1, STEPS + 1):
        # languages take turns, so frequent ones aren't favoured
        pick = np.concatenate([rng.choice(own, -(-BATCH // len(by_label))) for own in by_label])
        _, grads = _step(m, data[pick], mask[pick], truth[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
        rate = RATE * (1 - step / (STEPS + 1))
        for w, g, a, s in zip(m.weights, grads, first, second, strict=True):
            g = g * scale
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


class Reader:
    """Reads windows with a model, states kept as (H, B) so that every operation runs over long rows."""

    def __init__(self, m: Model):
        self.m = m
        self.x = [np.ascontiguousarray(x.T) for x in m.x]
        self.u = [np.ascontiguousarray(u.T) for u in m.u]
        self.v, self.c = np.ascontiguousarray(m.v.T), m.c[:, None]

    def probabilities(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(L, T, B) for bytes (B, T); mask None: all positions are there."""
        b, t = data.shape
        h = HIDDEN
        columns = np.ascontiguousarray(data.T)
        states = np.empty((2 * h, t, b), np.float32)
        for side in range(2):
            x, u, state = self.x[side], self.u[side], np.zeros((h, b), np.float32)
            for k in range(t) if side == 0 else range(t - 1, -1, -1):
                g, r = x.take(columns[k], axis=1), u @ state
                zr = g[: 2 * h]
                zr += r[: 2 * h]
                zr *= 0.25
                zr += 0.5
                np.clip(zr, 0, 1, out=zr)
                n = r[2 * h :]
                n *= zr[h:]
                n += g[2 * h :]
                np.tanh(n, out=n)
                state -= n
                state *= zr[:h]
                state += n
                if mask is not None:
                    state *= mask[:, k]
                states[side * h : side * h + h, k] = state
        logits = (self.v @ states.reshape(2 * h, -1)) + self.c
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits.reshape(-1, t, b)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(N, L): the mean of the positions' probabilities for each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.m.labels)))
        if not self.m.labels:
            return total
        data = np.frombuffer(b"".join(texts), np.uint8)
        start, length, which = cut(texts)
        full = length == WINDOW
        for rows in (np.flatnonzero(full), np.flatnonzero(~full)):
            for k in range(0, len(rows), BLOCK):
                own = rows[k : k + BLOCK]
                whole = bool(full[own[0]])
                block, mask = laid_out(data, start[own], length[own])
                p = self.probabilities(block, None if whole else mask)
                p = p.sum(1) if whole else (p * mask.T).sum(1)
                np.add.at(total, which[own], p.T)
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]

    def positions(self, text: bytes) -> np.ndarray:
        """The label number of every byte of a text."""
        data, mask, _ = windows([text])
        out = [self.probabilities(data[k : k + BLOCK], mask[k : k + BLOCK]).argmax(0).T for k in range(0, len(data), BLOCK)]
        return np.concatenate(out)[mask] if out else np.zeros(0, np.int64)


def fit(docs: DataFrame) -> Model:
    """Learns from text and non-null lang of documents outside the test fold, on a bounded sample: about
    ``PER_LANGUAGE`` documents of each language and ``SAMPLE`` in all, ``WINDOWS_EACH`` windows of each."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, TEST_FOLD))
    mark = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    sizes = rows.groupBy("lang").count().withColumnRenamed("lang", "_lang")
    share = F.lit(float(PER_LANGUAGE)) / F.col("count")
    drawn = F.shiftrightunsigned(mark, 12) / F.lit(float(1 << 52))
    ids = rows.select("doc_id", "lang").join(sizes, F.col("lang") == F.col("_lang")).where(drawn < share).orderBy(mark, "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_id")).distinct()
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.char_length("text") - WINDOW, F.lit(1))).cast("int") + 1
    parts = F.array(*[F.substring("text", at(i), F.lit(WINDOW)) for i in range(WINDOWS_EACH)])
    # the sample has at most SAMPLE rows
    found = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "lang", parts.alias("parts"))
    # where ids repeat there may be more rows; which of them are taken doesn't depend on their order
    found = found.orderBy("doc_id", "lang", "parts").limit(2 * SAMPLE).collect()
    return train([(r.lang, [p.encode() for p in r.parts]) for r in found])


def predict(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score (and without text, unless ``keep_text``). Null text, text without a letter, and any text if no label was learned: 'und'
    with score 0. Other columns pass through (those named like the results are replaced)."""
    keep = docs.drop("lang_pred", "score")
    names = [c for c in keep.columns if keep_text or c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name in names), "lang_pred string", "score double"])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        labels = np.array([*shared.value.labels, UNKNOWN], dtype=object)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = [t or "" for t in b.column("text").to_pylist()]
                p = reader.pooled([t.encode() for t in texts])
                b = b.select(names)
                letters = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
                known = letters if p.shape[1] else np.zeros(len(texts), bool)
                best = np.where(known, p.argmax(1), len(labels) - 1) if p.shape[1] else np.full(len(texts), len(labels) - 1)
                score = np.where(known, np.clip(p.max(1), 0, 1), 0.0) if p.shape[1] else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return keep.mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    lang, source and doc_id play no part in a prediction. Repeated rows get equal predictions; an empty table gives no
    rows (and no model); extra columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict(own.select("doc_id", "text"), fit(own), keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, TEST_FOLD).alias("held_out"), "lang_pred", "score")
