"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of those that the word and its first letters are hashed to, so inflected forms share what
is learned of their stem. Filters of several widths run over the words, each keeps its maximum over the whole document,
and a logistic layer makes the score. Training (by Adam, gradients through the maxima) reads every labelled document
outside the test fold, however many and however long: a few on the driver, more in shards. In a round each shard goes on
from the common model with its own documents, and a parameter's next value is the mean over the shards that moved it. For
reading, Arrow splits many texts together and numbers their different words; only these are hashed and multiplied by all
filters, and each word of a text costs one row lookup for each position of a filter.

Every one of these documents also calibrates: beside the model, two others learn from one half each, and score the half
they have not seen. By these scores 0.3 becomes the best threshold over all languages, and each language has one of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import drop_written, held_out, materialise, small_batches

#: Rows of the embedding table; row 0 is zero and stands for all that is rare.
BUCKETS, DIM = 1 << 16, 16
#: Beside the word itself its first letters, so many, are hashed.
PREFIXES = (4, 5, 6)
WIDTHS, FILTERS = (1, 2, 3), 12  # all widths from 1 on
#: Up to so many labelled documents and bytes of their texts are learned on the driver; a shard of more holds about so many.
ON_DRIVER, SHARD = (4_096, 32 << 20), (8_192, 32 << 20)
#: A row is rare if fewer labelled documents use it.
RARE = 6
#: Epochs on the driver; rounds over shards are as many as give a shard so many steps.
EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 900, 32, 0.02, 1e-4
#: Share of words left out at random in training, so that one of several signs has to be enough.
DROPPED = 0.3
#: A language needs so many documents of each label for its threshold.
ENOUGH = 10
THRESHOLD = 0.3
#: Shards send moves of parameters as whole numbers of this, so that sums don't depend on their order, in blocks of so many
#: rows of the table; logits are counted in steps of this.
STEP, BLOCK, GRID = 1 / (1 << 20), 1024, 1 / 256
FOLDS, TEST_FOLD = 4, 2
#: Different words that are multiplied by the filters together; words that are read at once.
REMEMBERED, CHUNK = 200_000, 200_000
#: Longer words are hashed singly, others so many together; filters run over so many words.
LONG, AT_ONCE, BLOCK_WORDS = 40, 8_192, 16_384
BLANK = re.compile(r"\s")
EDGES = ".,;:!?\"'()[]{}<>*_-…¡¿«»„“”‚‘’"
PAD = max(WIDTHS) - 1


def rows_of(word: str) -> list[int]:
    """The rows of a word: its own and its first letters'."""
    bare = word.strip(EDGES) or word
    parts = [bare, *(f"{n}:{bare[:n]}" for n in PREFIXES if len(bare) >= n)]
    out = [1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for p in parts]
    return out + [0] * (1 + len(PREFIXES) - len(out))


#: What a byte does to a CRC; what the letters' number in front of first letters of so many bytes does to it.
CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
AHEAD = np.array([[zlib.crc32(f"{n}:".encode() + bytes(k)) ^ zlib.crc32(bytes(k)) for k in range(4 * n + 1)] + [0] * 4 * (max(PREFIXES) - n) for n in PREFIXES], np.uint32)


def all_rows_of(words: list[str] | pa.Array) -> np.ndarray:
    """``rows_of`` for many words at once, byte by byte: one CRC runs over each word and is looked at again where its first
    letters end. Words of more than ``LONG`` letters are taken singly."""
    try:
        words = pa.array(words, pa.large_string())
    except UnicodeEncodeError:  # halves of surrogate pairs
        return np.array([rows_of(w) for w in words], np.int32)
    if len(words) > AT_ONCE:
        return np.concatenate([all_rows_of(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)])
    bare = pc.utf8_trim(words, characters=EDGES)
    bare = pc.if_else(pc.equal(bare, ""), words, bare)
    long = np.flatnonzero(pc.utf8_length(bare).to_numpy() > LONG)
    if len(long):
        bare = pc.if_else(pc.greater(pc.utf8_length(bare), LONG), "", bare)
    n = pc.utf8_length(bare).to_numpy().astype(np.int64)
    _, offsets, data = bare.buffers()
    offsets = np.frombuffer(offsets, np.int64)[bare.offset : bare.offset + len(bare) + 1] if len(bare) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    letter = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each begins
    first = np.cumsum(n) - n
    start = letter[first]
    size = letter[first + n] - start
    order = np.argsort((4 * LONG - size).astype(np.uint8), kind="stable")  # the longest first
    at, ends = start[order], size[order]
    most = int(ends[:1].sum())
    going = np.searchsorted(-ends, -np.arange(most), "left")  # words that have a further byte
    crc = np.full((most + 1, len(words)), 0xFFFFFFFF, np.uint32)
    for i, k in enumerate(going):
        crc[i + 1, :k] = CRC[(crc[i, :k] ^ data[at[:k] + i]) & 0xFF] ^ (crc[i, :k] >> 8)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    found = [~crc[size, place]]
    for k, ahead in zip(PREFIXES, AHEAD, strict=True):
        own = letter[first + np.minimum(k, n)] - start
        found.append(~crc[own, place] ^ ahead[own])
    out = 1 + (np.stack(found, 1) % (BUCKETS - 1)).astype(np.int32)
    out[:, 1:][n[:, None] < PREFIXES] = 0
    for i in long:
        out[i] = rows_of(words[int(i)].as_py())
    return out


def numbered(texts: list[str]) -> tuple[list[np.ndarray], list[str] | pa.Array]:
    """The words of lower-cased texts as numbers from 0, and the words in the order they are met. Arrow knows the same white
    space as ``str.split``, but gives an empty word where a text begins or ends with it."""
    if not texts:
        return [], []
    try:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    except UnicodeEncodeError:  # halves of surrogate pairs
        words = Words()
        return [words.of(t.split()) - 1 for t in texts], [*words]
    flat = split.flatten().dictionary_encode()
    ids, met, bounds = flat.indices.to_numpy(), flat.dictionary, split.offsets.to_numpy()
    empty = pc.index(met, "").as_py()
    if empty >= 0:
        keep = ids != empty
        bounds = np.append(0, np.cumsum(keep))[bounds]
        ids = ids[keep]
        ids = ids - (ids > empty)
        met = pa.concat_arrays([met[:empty], met[empty + 1 :]])
    return np.split(ids, bounds[1:-1]), met


class Words(defaultdict):
    """Numbers words in the order they are met, from 1 (0 stands between documents)."""

    def __init__(self):
        super().__init__(count(1).__next__)
        self._rows = np.zeros((1, 1 + len(PREFIXES)), np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The same for the words of lower-cased texts."""
        ids, met = numbered(texts)
        among = self.of(met if isinstance(met, list) else met.to_numpy(zero_copy_only=False).tolist())
        return [among[i] for i in ids]

    @property
    def rows(self) -> np.ndarray:
        """The rows of each number; those of new words are looked up here, together."""
        new = [*islice(reversed(self), len(self) + 1 - len(self._rows))][::-1]
        if new:
            self._rows = np.concatenate([self._rows, all_rows_of(new)])
        return self._rows


def in_parts(text: str, most: int | None = None) -> Iterator[tuple[list[str], bool]]:
    """The words of a text in parts of ``most`` at most, and whether a part is the last; each begins with the last ``PAD``
    words of the one before. A text is cut into words a stretch at a time."""
    most = most or CHUNK
    held: list[str] = []
    at, stretch = 0, 4 * most
    while at < len(text):
        end = len(text)
        if end - at > stretch:  # the stretch ends behind white space
            gap = BLANK.search(text, at + stretch)
            end = gap.end() if gap else end
        held += text[at:end].lower().split()
        at = end
        while len(held) > most:
            yield held[:most], False
            held = held[most - PAD :]
    yield held, True


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)


def _new(rng: np.random.Generator) -> Model:
    f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    table = f(BUCKETS, DIM, scale=0.02)
    table[0] = 0
    return Model(table, [f(w, DIM, FILTERS, scale=0.3) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), f(len(WIDTHS) * FILTERS, scale=0.3), np.zeros(1, np.float32))


def _lay_out(docs: list[np.ndarray], cut: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' words in a row with zeros after each, where each starts, and how many windows begin in it: at each
    word, or one if there is none. Where a document is ``cut``, windows that reach behind its end belong to the next."""
    size = np.array([len(d) for d in docs])
    start = np.cumsum(size + PAD + 1) - (size + PAD + 1)
    ids = np.zeros(int((size + PAD + 1).sum()), np.int32)
    for s, d in zip(start, docs, strict=True):
        ids[s : s + len(d)] = d
    return ids, start, np.maximum(1, size - PAD * np.array(cut or [False] * len(docs)))


def _blocks(sizes: list[int]) -> Iterator[slice]:
    """Neighbours that have ``BLOCK_WORDS`` words together, or one that has more."""
    start = n = 0
    for i, k in enumerate(sizes):
        if i > start and n + k > BLOCK_WORDS:
            yield slice(start, i)
            start, n = i, 0
        n += k
    yield slice(start, len(sizes))


def _values(taps: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """(positions, filters): the filters' values at every position."""
    v = taps[0].take(ids, axis=0)
    for k, t in enumerate(taps[1:], 1):
        v[: len(ids) - k, k * FILTERS :] += t.take(ids[k:], axis=0)
    return v


def _pooled(taps: list[np.ndarray], ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(documents, filters): the maxima over each document's windows."""
    v = _values(taps, ids)
    return np.stack([v[a : a + k].max(0) for a, k in zip(start, n, strict=True)])


def _taps(words: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """For each place in a window what a word there adds to the filters that are as wide, one width after the other."""
    return [words @ np.concatenate([f[k] for f in filters if len(f) > k], axis=1) for k in range(max(WIDTHS))]


def _embedded(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words' embeddings: sums over their rows."""
    out = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += table.take(rows[:, k], axis=0)
    return out


def _met(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, all below ``most``, in order, and the place of each number among them."""
    mark = np.zeros(most, bool)
    mark[ids] = True
    met = np.flatnonzero(mark)
    place = np.empty(most, np.int32)
    place[met] = np.arange(len(met), dtype=np.int32)
    return met, place[ids]


def _logits(m: Model, top: np.ndarray) -> np.ndarray:
    return np.maximum(top + m.bias, 0) @ m.out + m.out_bias[0]


def _windows(m: Model, rows: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(documents, filters): the maxima of documents that are laid out; for each width (documents, FILTERS, width): the words
    of the windows they lie in."""
    met, local = _met(ids, len(rows))
    v = _values(_taps(_embedded(m.table, rows[met]), m.filters), local)
    at = np.stack([a + v[a : a + k].argmax(0) for a, k in zip(start, n, strict=True)])
    own = [at[:, i * FILTERS : (i + 1) * FILTERS, None] for i in range(len(WIDTHS))]
    return np.take_along_axis(v, at, axis=0), [ids[np.minimum(a + np.arange(w), len(ids) - 1)] for w, a in zip(WIDTHS, own, strict=True)]


def _read(m: Model, rows: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of whole documents of any length, which are read in parts of ``CHUNK`` words at most."""
    top = np.full((len(docs), len(m.bias)), -np.inf, m.table.dtype)
    won = [np.zeros((len(docs), FILTERS, w), np.int32) for w in WIDTHS]
    parts: list[np.ndarray] = []
    which: list[int] = []
    cut: list[bool] = []

    def merge() -> None:
        best, theirs = _windows(m, rows, *_lay_out(parts, cut))
        for j, i in enumerate(which):
            more = best[j] > top[i]
            top[i][more] = best[j][more]
            for w, own in enumerate(theirs):
                k = more[w * FILTERS : (w + 1) * FILTERS]
                won[w][i][k] = own[j][k]
        parts.clear(), which.clear(), cut.clear()

    n = 0
    for i, d in enumerate(docs):
        for at in range(0, max(1, len(d) - PAD), CHUNK - PAD):
            part = d[at : at + CHUNK]
            if parts and n + len(part) > CHUNK:
                merge()
                n = 0
            parts.append(part)
            which.append(i)
            cut.append(at + CHUNK < len(d))
            n += len(part)
    if parts:
        merge()
    return top, won


def _back(m: Model, rows: np.ndarray, top: np.ndarray, won: list[np.ndarray], truth: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss of documents with these maxima, its gradients, and the rows of the table that the table's are for."""
    act = np.maximum(top + m.bias, 0)
    logits = np.clip(act @ m.out + m.out_bias[0], -30, 30)
    p = 1 / (1 + np.exp(-logits))
    loss = float((weight * (np.logaddexp(0, logits) - truth * logits)).mean())
    d = ((p - truth) * weight / len(truth)).astype(m.table.dtype)
    dact = d[:, None] * m.out * (act > 0)
    grads = {"out": act.T @ d, "out_bias": d.sum(keepdims=True), "bias": dact.sum(0)}
    met, place = np.unique(np.concatenate([w.reshape(-1) for w in won]), return_inverse=True)
    words, dwords = _embedded(m.table, rows[met]), np.zeros((len(met), DIM), m.table.dtype)
    seen = 0
    for i, (f, ids) in enumerate(zip(m.filters, won, strict=True)):
        own, at = dact[:, i * FILTERS : (i + 1) * FILTERS], place[seen : seen + ids.size].reshape(ids.shape)
        seen += ids.size
        grads[f"f{i}"] = np.einsum("dkwe,dk->wek", words[at], own)
        doc, k = np.nonzero(own)
        np.add.at(dwords, at[doc, k], own[doc, k][:, None, None] * f.transpose(2, 0, 1)[k])
    touched = np.flatnonzero(dwords.any(1))
    used, place = np.unique(rows[met[touched]], return_inverse=True)
    grads["table"] = np.zeros((len(used), DIM), m.table.dtype)
    np.add.at(grads["table"], place.reshape(len(touched), 1 + len(PREFIXES)), dwords[touched][:, None, :])
    grads["table"][used == 0] = 0
    return loss, grads, used


def _gradients(m: Model, rows: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """The same of documents that are laid out."""
    return _back(m, rows, *_windows(m, rows, ids, start, n), truth, weight)


def _params(m: Model) -> dict[str, np.ndarray]:
    return {"bias": m.bias, "out": m.out, "out_bias": m.out_bias} | {f"f{i}": f for i, f in enumerate(m.filters)}


def _epoch(m: Model, docs: list[np.ndarray], rows: np.ndarray, truth: np.ndarray, order: np.ndarray, state: dict, weight: np.ndarray, rate: float, rng: np.random.Generator, batch: int) -> None:
    params = {"table": m.table} | _params(m)
    for k in range(0, len(order), batch):
        pick = order[k : k + batch]
        size = np.cumsum([len(docs[i]) for i in pick])
        ids = np.concatenate([docs[i] for i in pick])
        ids[rng.random(len(ids), np.float32) < DROPPED] = 0
        _, grads, used = _back(m, rows, *_read(m, rows, np.split(ids, size[:-1])), truth[pick], weight[pick])
        for name in ("out", *(f"f{i}" for i in range(len(m.filters)))):
            grads[name] = grads[name] + DECAY * params[name]
        for name, g in grads.items():
            if name not in state:
                state[name] = [np.zeros_like(params[name]), np.zeros_like(params[name])]
            a, s = state[name]
            at = used if name == "table" else slice(None)
            a[at] = 0.9 * a[at] + 0.1 * g
            s[at] = 0.99 * s[at] + 0.01 * g * g
            params[name][at] -= rate * a[at] / (np.sqrt(s[at]) + 1e-3)


def _best(logits: np.ndarray, toxic: np.ndarray, of: np.ndarray | None = None) -> float:
    """The threshold of best F1, in the middle of the gap it lies in; ``toxic`` of so many documents at each logit."""
    of = np.ones(len(logits)) if of is None else of
    order = np.argsort(-logits)
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.cumsum(of[order]) + toxic.sum())
    k = int(f1.argmax())
    return float((logits[order[k]] + (logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1)) / 2)


def _uses(docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """By how many documents each row of the table is used."""
    out, mark = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
    for d in docs:
        mark[rows[d]] = True
        at = np.flatnonzero(mark)
        out[at] += 1
        mark[at] = False
    return out


def _weights(truth: np.ndarray, share: float) -> np.ndarray:
    """Both labels weigh as much; ``share`` of the documents are toxic."""
    return np.where(truth > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


def _copy(m: Model) -> Model:
    return Model(m.table.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.out.copy(), m.out_bias.copy())


def _unseen(m: Model, rows: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    parts = [_logits(m, _read(m, rows, docs[k : k + 256])[0]) for k in range(0, len(docs), 256)]
    return np.concatenate(parts) if parts else np.zeros(0, m.table.dtype)


def _constant(m: Model, toxic: bool) -> Model:
    """Where there is nothing to tell labels by, every score is the same."""
    m.out[:] = 0
    m.shift = -5.0 if toxic else 5.0
    return m


def train(rows: list[tuple[str, int, str | None]], seed: int = 11) -> Model:
    """A model from (text, toxic, language or None); the language serves only to set thresholds."""
    rng = np.random.default_rng(seed)
    m = _new(rng)
    words = Words()
    docs = words.of_texts([t.lower() for t, _, _ in rows])
    truth = np.array([float(y) for _, y, _ in rows])
    if len(set(truth)) < 2 or len(rows) < RARE:
        return _constant(m, len(truth) > 0 and bool(truth.all()))
    uses = words.rows.copy()
    rare = _uses(docs, uses) < RARE
    rare[0] = True
    m.table[rare] = 0
    uses[rare[uses]] = 0
    half = np.zeros(len(rows), np.int64)
    for y in (0, 1):  # as many of either label in either half
        own = rng.permutation(np.flatnonzero(truth == y))
        half[own[1::2]] = 1

    def learned(own: np.ndarray, batch: int) -> Model:
        out, state, weight = _copy(m), {}, _weights(truth, truth[own].mean())
        for e in range(EPOCHS):
            _epoch(out, docs, uses, truth, rng.permutation(own), state, weight, RATE * (1 - e / EPOCHS), rng, batch)
        return out

    whole = learned(np.arange(len(rows)), BATCH)
    if min(truth.sum(), (1 - truth).sum()) < 2:
        return whole
    logits = np.zeros(len(rows))
    for h in (0, 1):  # in as many steps as the whole
        other = np.flatnonzero(half != h)
        logits[other] = _unseen(learned(np.flatnonzero(half == h), BATCH // 2), uses, [docs[i] for i in other])
    whole.shift = _best(logits, truth)
    languages = np.array([g or "" for _, _, g in rows], dtype=object)
    for name in sorted({*languages} - {""}):
        own = languages == name
        if min(truth[own].sum(), (1 - truth[own]).sum()) >= ENOUGH:
            whole.by_language[name] = float(_score(np.array([_best(logits[own], truth[own])]), whole)[0])
    return whole


@dataclass
class Shard:
    """Documents as numbers of words, and the rows of each word."""

    number: int
    docs: list[np.ndarray]
    rows: np.ndarray
    truth: np.ndarray
    languages: list[str | None]

    COLUMNS = "shard int, n int, toxic int, sizes binary, ids binary, words binary, truth binary, languages array<string>"

    def packed(self) -> pa.RecordBatch:
        sizes = np.array([len(d) for d in self.docs], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *self.docs])
        data = [self.number, len(self.docs), int(self.truth.sum()), sizes.tobytes(), ids.tobytes(), self.rows.astype(np.uint16).tobytes(), self.truth.astype(np.uint8).tobytes(), self.languages]
        types = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(data, types, strict=True)], names=[c.split(" ")[0] for c in self.COLUMNS.split(", ")])

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for b in batches:
            for i in range(b.num_rows):
                number, sizes, ids, words, truth, languages = (b.column(c)[i].as_py() for c in ("shard", "sizes", "ids", "words", "truth", "languages"))
                docs = np.split(np.frombuffer(ids, np.int32), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
                yield Shard(number, docs, np.frombuffer(words, np.uint16).astype(np.int32).reshape(-1, 1 + len(PREFIXES)), np.frombuffer(truth, np.uint8).astype(float), languages)


def _packed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of (shard, doc_id, text, toxic, lang) as one row for each of ``n`` shards. Those of a shard, and in it those of an id,
    follow each other, and an id's labels (without text) come before its texts (without label). What is left of a shard that
    gets twice as long as it should, as ids may repeat, is a further one of the same half."""
    words, docs, truth, languages, number, size = Words(), [], [], [], None, 0
    labelled, labels, waiting = None, [], 0
    ahead: list[str] = []  # texts whose words aren't numbered yet

    def number_words() -> None:
        nonlocal waiting
        docs.extend(words.of_texts(ahead))
        ahead.clear()
        waiting = 0

    def packed() -> Iterator[pa.RecordBatch]:
        nonlocal words, docs, truth, languages, size
        if truth:
            number_words()
            yield Shard(number, docs, words.rows, np.array(truth), languages).packed()
        words, docs, truth, languages, size = Words(), [], [], [], 0

    for b in batches:
        for shard, i, text, y, g in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "text", "toxic", "lang")), strict=True):
            if number is None or number % n != shard:
                yield from packed()
                number = shard
            if text is None:
                labels = [*labels, y] if labelled == i else [y]
                labelled = i
                continue
            for label in labels if labelled == i else ():
                if len(truth) >= 2 * SHARD[0] or size >= 2 * SHARD[1]:
                    yield from packed()
                    number += n
                ahead.append(text.lower())
                truth.append(label)
                languages.append(g)
                size += len(text)
                waiting += len(text)
                if waiting > 4 * CHUNK:
                    number_words()
    yield from packed()


def _let_through(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts of all labelled ids, and of few others, by a Bloom filter of two to four bytes for each label; so that texts
    without a label are not shuffled."""
    bits = 1 << max(10, (16 * known.count()).bit_length())
    mark = lambda c: F.xxhash64(c, F.lit("toxicity labels"))
    places = F.array(*[F.pmod(F.shiftright(mark("_id"), 20 * k), F.lit(bits)) for k in range(3)])
    found = known.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("set")).toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[found["word"]] = found["set"]
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            h, keep = b.column("_mark").to_numpy(), np.ones(b.num_rows, bool)
            for k in range(3):
                at = (h >> 20 * k) % bits
                keep &= (table[at >> 6] >> (at & 63)) & 1 == 1
            yield b.drop_columns(["_mark"]).filter(pa.array(keep))

    return texts.withColumn("_mark", mark("doc_id")).mapInArrow(run, texts.schema)


MOVES = "which int, block int, at binary, moved binary"


def _batch(which: int, block: int, at: bytes, moved: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.binary()), pa.array([moved], pa.binary())], names=["which", "block", "at", "moved"])


def _in_blocks(which: int, at: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is to be added to some rows (in order) of a table, by blocks of the table."""
    bounds = np.flatnonzero(np.diff(at // BLOCK)) + 1
    for a, v in zip(np.split(at, bounds), np.split(moved, bounds), strict=True):
        if len(a):
            yield _batch(which, int(a[0] // BLOCK), (a % BLOCK).astype(np.uint16).tobytes(), v.astype(np.int32).tobytes())


def _summed(moves: DataFrame, mean: bool) -> list:
    """For each block that something is added to, the sum of it, or the mean over those that add to a row; as a table of
    doubles or floats that comes to the driver, at most the size of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for which, block, at, moved in zip(*(b.column(c).to_pylist() for c in ("which", "block", "at", "moved")), strict=True):
                at = np.frombuffer(at, np.uint16)
                moved = np.frombuffer(moved, np.int32).reshape(len(at), -1)
                if (which, block) not in held:
                    n = BLOCK if block >= 0 else 1
                    held[which, block] = np.zeros((n, 1), np.int64), np.zeros((n, moved.shape[1]), np.int64)
                count, total = held[which, block]
                count[at] += 1
                total[at] += moved
        for (which, block), (count, total) in held.items():
            yield _batch(which, block, b"", (total / np.maximum(count, 1) * STEP).astype(np.float32).tobytes() if mean else total.astype(np.float64).tobytes())

    return moves.repartition("which", "block").mapInArrow(run, MOVES).select("which", "block", "moved").collect()


def _round(shards: DataFrame, models: list[Model], rare: np.ndarray, shares: list[float], rate: float, seed: list[int]) -> None:
    """Each shard teaches the model of all shards and that of its half; these go on from the means."""
    sc = shards.sparkSession.sparkContext
    shared = sc.broadcast((models, rare, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, rare, shares = shared.value
        for s in Shard.of(batches):
            s.rows[rare[s.rows]] = 0
            for which in (0, 1 + s.number % 2):
                was, m, rng = models[which], _copy(models[which]), np.random.default_rng([*seed, s.number, which])
                _epoch(m, s.docs, s.rows, s.truth, rng.permutation(len(s.docs)), {}, _weights(s.truth, shares[which]), rate, rng, BATCH)
                whole = lambda x: np.clip(np.rint(x.astype(np.float64) / STEP), -(1 << 31), (1 << 31) - 1)
                at = np.flatnonzero((m.table != was.table).any(1))
                yield from _in_blocks(which, at, whole(m.table[at] - was.table[at]))
                moved = np.concatenate([(p - q).reshape(-1) for p, q in zip(_params(m).values(), _params(was).values(), strict=True)])
                yield _batch(which, -1, np.zeros(1, np.uint16).tobytes(), whole(moved).astype(np.int32).tobytes())

    for r in _summed(shards.mapInArrow(run, MOVES), mean=True):
        moved = np.frombuffer(r.moved, np.float32)
        if r.block >= 0:
            models[r.which].table[r.block * BLOCK : (r.block + 1) * BLOCK] += moved.reshape(BLOCK, DIM)
            continue
        for p in _params(models[r.which]).values():
            p += moved[: p.size].reshape(p.shape)
            moved = moved[p.size :]
    shared.destroy()


def _calibrate(shards: DataFrame, models: list[Model], rare: np.ndarray) -> None:
    """Sets the first model's thresholds by what the models of the halves make of the other half. Logits are counted in
    steps of ``GRID`` up to 30, so that what comes to the driver and what a language gathers is bounded."""
    shared = shards.sparkSession.sparkContext.broadcast((models, rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, rare = shared.value
        for s in Shard.of(batches):
            s.rows[rare[s.rows]] = 0
            logits = _unseen(models[2 - s.number % 2], s.rows, s.docs)
            counts: dict[tuple[str | None, int], list[int]] = {}
            for g, step, y in zip(s.languages, np.rint(np.clip(logits, -30, 30) / GRID).astype(np.int64).tolist(), s.truth, strict=True):
                own = counts.setdefault((g, step), [0, 0])
                own[0] += 1
                own[1] += int(y)
            columns = [g for g, _ in counts], [k for _, k in counts], [n for n, _ in counts.values()], [y for _, y in counts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)], names=["lang", "step", "n", "toxic"])

    def best(own: pd.DataFrame) -> float:
        return _best(own["step"].to_numpy() * GRID, own["toxic"].to_numpy(), own["n"].to_numpy())

    def by_language(own: pd.DataFrame) -> pd.DataFrame:
        toxic = own["toxic"].sum()
        enough = min(toxic, own["n"].sum() - toxic) >= ENOUGH
        return pd.DataFrame({"lang": pd.Series([own["lang"].iloc[0]], dtype=object), "at": [best(own) if enough else float("nan")]})

    schema = "lang string, step bigint, n bigint, toxic bigint"
    counts = materialise(shards.mapInArrow(run, schema).groupBy("lang", "step").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    try:
        m = models[0]
        m.shift = best(counts.groupBy("step").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toPandas())
        found = counts.where("lang IS NOT NULL AND lang != ''").groupBy("lang").applyInPandas(by_language, "lang string, at double").where("at IS NOT NULL AND NOT isnan(at)").collect()
        m.by_language = {r["lang"]: float(_score(np.array([r["at"]]), m)[0]) for r in sorted(found)}
    finally:
        drop_written(counts)
        shared.destroy()


def train_sharded(texts: DataFrame, known: DataFrame, count: int, size: int, seed: int = 11) -> Model:
    """A model from texts (doc_id, text, lang) and known (_id, toxic), of which so many rows with so many bytes of text meet. A
    row's shard and its place there follow from the row, and sums are of whole numbers, so the model doesn't depend on how rows
    lie in partitions."""
    n = 2 * max(1, -(-count // (2 * SHARD[0])), -(-size // (2 * SHARD[1])))
    rows = _let_through(texts, known).withColumn("toxic", F.lit(None).cast("int")).unionByName(known.select(F.col("_id").alias("doc_id"), "toxic"), allowMissingColumns=True)
    mark = F.xxhash64("doc_id", F.lit("toxicity shard"))
    dealt = rows.select(F.pmod(mark, F.lit(n)).cast("int").alias("shard"), mark.alias("mark"), "doc_id", "text", "toxic", "lang")
    dealt = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "mark", "doc_id", F.col("text").isNotNull(), "text", "toxic", "lang")
    shards = materialise(dealt.select("shard", "doc_id", "text", "toxic", "lang").mapInArrow(lambda batches: _packed(batches, n), Shard.COLUMNS), "toxicity-shards")
    try:
        halves = {r.half: r for r in shards.groupBy((F.col("shard") % 2).alias("half")).agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()}
        sizes = [(halves[h].n, halves[h].toxic) if h in halves else (0, 0) for h in (0, 1)]
        shares = [t / max(k, 1) for k, t in [(sum(k for k, _ in sizes), sum(t for _, t in sizes)), *sizes]]
        m = _new(np.random.default_rng(seed))
        if shares[0] in (0, 1):
            return _constant(m, shares[0] == 1)

        def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in Shard.of(batches):
                c = _uses(s.docs, s.rows)
                yield from _in_blocks(0, np.flatnonzero(c), c[c > 0])

        rare = np.ones(BUCKETS, bool)
        for r in _summed(shards.mapInArrow(used, MOVES), mean=False):
            rare[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.moved) < RARE
        rare[0] = True
        m.table[rare] = 0
        models = [m, _copy(m), _copy(m)]
        rounds = -(-STEPS * BATCH * n // count)
        for e in range(rounds):
            _round(shards, models, rare, shares, RATE * (1 - e / rounds), [seed, e])
        if all(0 < s < 1 for s in shares):
            _calibrate(shards, models, rare)
        return m
    finally:
        drop_written(shards)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _score(logits: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits - m.shift + _logit(THRESHOLD), -40, 40)))


class Reader:
    def __init__(self, m: Model):
        self.m = m

    def _taps(self, met: list[str] | pa.Array) -> list[np.ndarray]:
        """Of different words, behind those of no word."""
        pieces = [_taps(_embedded(self.m.table, all_rows_of(met[k : k + REMEMBERED])), self.m.filters) for k in range(0, len(met), REMEMBERED)]
        return [np.concatenate([np.zeros((1, (len(WIDTHS) - k) * FILTERS), self.m.table.dtype), *(p[k] for p in pieces)]) for k in range(max(WIDTHS))]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts; very long ones are read in parts whose maxima are joined."""
        top = np.full((len(texts), len(self.m.bias)), -np.inf, np.float32)
        parts: list[str] = []
        which: list[int] = []
        cut: list[bool] = []

        def read() -> None:
            ids, met = numbered(parts)
            taps = self._taps(met)
            for own in _blocks([len(d) for d in ids]):
                best = _pooled(taps, *_lay_out([d + 1 for d in ids[own]], cut[own]))
                np.maximum.at(top, which[own], best)
            parts.clear(), which.clear(), cut.clear()

        n = 0
        for i, t in enumerate(texts):
            whole = [(t.lower(), True)] if len(t) <= CHUNK else ((" ".join(words), end) for words, end in in_parts(t))
            for part, end in whole:
                if parts and n + len(part) > 4 * CHUNK:
                    read()
                    n = 0
                parts.append(part)
                which.append(i)
                cut.append(not end)
                n += len(part)
        if parts:
            read()
        return _score(_logits(self.m, top).astype(np.float64), self.m)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from every labelled document outside the test fold, whole. Rows with a null text, id or label are left out."""
    outside = lambda c: c.isNotNull() & ~held_out(c, FOLDS, TEST_FOLD)
    same = labels.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = same.where(F.col("toxic").isNotNull() & outside(F.col("_id")))
    texts = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & outside(F.col("doc_id")))
    small_batches(docs.sparkSession)
    meet = F.col("doc_id") == F.col("_id")
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(known, meet)
    count, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if count > ON_DRIVER[0] or size > ON_DRIVER[1]:
        return train_sharded(texts, known, count, size)
    few = known.join(texts.select("doc_id"), meet, "left_semi")  # as just counted
    rows = texts.join(F.broadcast(few), meet).orderBy("doc_id", "toxic", F.xxhash64("text"), "text", "lang").collect()
    return train([(r.text, r.toxic, r.lang) for r in rows])


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with score: a double from 0 to 1 for every row (and without text, unless ``keep_text``). Null and empty texts are read as texts without a word.
    Other columns pass through (one named score is replaced)."""
    keep = docs.drop("score")
    names = [c for c in keep.columns if keep_text or c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name in names), "score double"])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                s = reader.scores([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(s, pa.float64())], names=[*names, "score"])

    return keep.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and by_language (score >= the threshold of the document's
    language; 0.3 where too few of it are labelled) for every document.

    Scores depend on the text alone. Repeated rows get equal scores; an empty table gives no rows; without both labels
    every score is the same. Extra columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(own, labels)
    limit = F.lit(THRESHOLD)
    for name, at in model.by_language.items():
        limit = F.when(F.col("lang") == name, F.lit(at)).otherwise(limit)
    out = score(own, model, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, TEST_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= limit).cast("int").alias("by_language"))
