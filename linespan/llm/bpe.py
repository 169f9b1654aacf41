"""Byte-level BPE by recursive DuckDB queries inside each partition.

A worker cuts texts into words by the pattern, and DuckDB encodes the words it hasn't met: a recursive query turns each
into token-position rows, joins neighbouring tokens with the merge table and contracts every word's leftmost pair of
least rank, until no word has a pair left. Decoding joins token rows with the vocabulary and puts their bytes together by
an ordered aggregation.

A round contracts one pair of each word, so a long word is contracted in windows. That is exact: tokens are the
encoding of their bytes if and only if every two neighbours, contracted alone, come back as themselves. (The first
contraction across a border sees only the two tokens beside it, and what happened inside them is what happens when
they are alone.) So only the junctions of windows are tried; where one doesn't hold, the tokens around it are
contracted together, more of them each time, until all do.

The rank file is read by the driver (it has a fixed size, the vocabulary's) and sent to the executors as a broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import small_batches

#: Bytes of words in a recursive query; token cells that its rounds may keep; tokens decoded by one aggregation.
CHUNK_BYTES, CELLS, CHUNK_TOKENS = 250_000, 8_000_000, 300_000
#: Rounds of a query at most; words that aren't done by then go into the next query.
ROUNDS = 64
#: Bytes of the windows that words are cut into, and tokens on each side of a junction that is opened for the first time.
WINDOW, OPENED = 32, 4
#: Characters of texts that are encoded at once, and how far beyond its end the pattern may look to find a match.
SLICE, AHEAD = 1_000_000, 64
#: A Python worker remembers so many words and bytes of words, then starts anew; and so many pairs of tokens.
REMEMBERED, REMEMBERED_BYTES = 200_000, 6_000_000
MEMORY = "96MB"

_ENCODE = """
WITH RECURSIVE words AS (
  SELECT 0 AS round, word, tokens, false AS done FROM start
  UNION ALL
  SELECT round + 1, w.word,
         CASE WHEN best IS NULL THEN tokens
              ELSE list_concat(list_concat(list_slice(tokens, 1, best % 4194304 - 1), [CAST(best // 4194304 AS INTEGER)]),
                               list_slice(tokens, best % 4194304 + 2, len(tokens))) END,
         best IS NULL
  FROM (SELECT round, word, tokens FROM words WHERE NOT done AND round < {rounds}) w
  LEFT JOIN (
    SELECT word, min(m.rank * 4194304 + position) AS best
    FROM (SELECT word, unnest(range(1, len(tokens))) AS position, unnest(list_slice(tokens, 1, len(tokens) - 1)) AS l,
                 unnest(list_slice(tokens, 2, len(tokens))) AS r
          FROM words WHERE NOT done AND round < {rounds}) p
    JOIN merges m ON m.l = p.l AND m.r = p.r
    GROUP BY word) b ON b.word = w.word)
SELECT word, tokens, done FROM words WHERE done OR round = {rounds} ORDER BY word
"""
_DECODE = """
SELECT doc, array_to_string(list(bytes ORDER BY position), '') AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Words(dict):
    """The number of each word; a word that is looked up for the first time gets the next and is put down as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int32()))


class Codec:
    """Encodes and decodes in one process, by DuckDB."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        a, b, rank = zip(*pairs, strict=True) if pairs else ((), (), ())
        self._table("merges", {"l": pa.array(a, pa.int32()), "r": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int64())})
        # a character for each byte, as texts are what DuckDB strings together
        self._table("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks])})
        self.holds: dict[tuple[int, int], bool] = {}
        self._start([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _forget(self) -> None:
        """Starts with the words that were met more than once, if they are no more than half of what may be remembered."""
        again = np.flatnonzero(self.met > 1)
        again = again if len(again) <= REMEMBERED // 2 else again[:0]
        names = list(self.words)
        words = [names[i] for i in again.tolist()]
        self._start(words, self.tokens[self._range(self.starts[again], self.sizes[again])], self.sizes[again])

    def _start(self, words: list[str], tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.words = _Words()
        self.words.update(zip(words, range(len(words)), strict=True))
        self.tokens, self.sizes, self.starts = tokens, sizes, np.cumsum(sizes) - sizes
        self.met, self.remembered = np.zeros(len(words), np.int64), sum(map(len, words))

    @staticmethod
    def _range(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """start, start + 1, ... of each, one after the other."""
        end = np.cumsum(sizes)
        return np.repeat(starts - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words one after the other, and how many each has, by the recursive query alone; chunks and
        rounds keep within ``CELLS``."""
        size = np.array([len(w) for w in words], np.int64)
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(todo := np.flatnonzero(size > 0)):
            start, done = np.cumsum(size) - size, []
            ends = np.cumsum(size[todo])
            at, parts, sizes = 0, [], np.zeros(len(words), np.int64)
            while at < len(todo):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
                part, at = todo[at:end], end
                given = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[part])], pa.int32()), pa.array(flat[self._range(start[part], size[part])], pa.int32()))
                rounds = max(1, min(ROUNDS, CELLS // len(given.flatten())))
                self.con.register("start", pa.table({"word": pa.array(np.arange(len(part), dtype=np.int32)), "tokens": given}))
                found = self.con.sql(_ENCODE.format(rounds=rounds)).to_arrow_table().combine_chunks()
                self.con.unregister("start")
                lists = found.column("tokens").combine_chunks()
                parts.append(lists.flatten().to_numpy())
                sizes[part] = lists.value_lengths().to_numpy()
                done.append(found.column("done").to_numpy())
            flat, size = np.concatenate(parts), sizes
            if np.concatenate(done).all():
                break
            # those that are done go through once more and stay as they are
        return flat, size

    def _hold(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], bool]:
        """Whether two tokens, contracted alone, come back as themselves."""
        new = [p for p in pairs if p not in self.holds]
        if len(self.holds) + len(new) > REMEMBERED:
            self.holds, new = {}, list(pairs)
        flat, size = self._contract([self.bytes[a] + self.bytes[b] for a, b in new])
        for pair, ids in zip(new, np.split(flat, np.cumsum(size)[:-1]), strict=False):
            self.holds[pair] = tuple(ids.tolist()) == pair
        return self.holds

    def contract(self, words: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
        """The tokens of words of any length, in windows of so many bytes."""
        cut = [w[k : k + window] for w in words for k in range(0, max(len(w), 1), window)]
        flat, size = self._contract(cut)
        parts, n = np.split(flat, np.cumsum(size)[:-1]) if cut else [], [max(1, -(-len(w) // window)) for w in words]
        out: list[np.ndarray] = []
        open_at: dict[int, dict[int, int]] = {}  # of a word: the junctions that aren't known to hold, and how often they were opened
        for w, (k, m) in enumerate(zip(np.cumsum([0, *n]).tolist(), n, strict=False)):
            own = parts[k : k + m]
            out.append(np.concatenate(own) if m > 1 else own[0])
            if m > 1:
                open_at[w] = dict.fromkeys(np.cumsum([len(p) for p in own])[:-1].tolist(), 0)
        while open_at:
            pair = lambda w, at: (int(out[w][at - 1]), int(out[w][at]))
            holds = self._hold({pair(w, at) for w, some in open_at.items() for at in some})
            spans: list[tuple[int, int, int, int]] = []  # word, from, to, times opened
            for w, some in open_at.items():
                for at, times in sorted(some.items()):
                    if holds[pair(w, at)]:
                        continue
                    low, high = max(0, at - (OPENED << times)), min(len(out[w]), at + (OPENED << times))
                    if spans and spans[-1][0] == w and spans[-1][2] >= low:
                        _, before, end, most = spans.pop()
                        low, high, times = min(low, before), max(high, end), max(times, most)
                    spans.append((w, low, high, times))
            again = self.contract([b"".join(map(self.bytes.__getitem__, out[w][low:high].tolist())) for w, low, high, _ in spans], 2 * window)
            open_at, pieces, moved = {}, {}, {}
            for (w, low, high, times), ids in zip(spans, again, strict=True):
                done, shift = moved.get(w, (0, 0))
                pieces.setdefault(w, []).extend((out[w][done:low], ids))
                for at, inner in ((low + shift, low > 0), (low + shift + len(ids), high < len(out[w]))):
                    if inner:
                        open_at.setdefault(w, {})[at] = times + 1
                moved[w] = high, shift + len(ids) - (high - low)
            for w, some in pieces.items():
                out[w] = np.concatenate([*some, out[w][moved[w][0] :]])
        return out

    def _learn(self) -> None:
        """Encodes the words that are new."""
        new = [w.encode("utf-8", "surrogatepass") for w in self.words.new]
        self.words.new = []
        bytes_of = np.array([len(w) for w in new])
        rank = np.array([self.ranks.get(w, -1) for w in new], np.int32)
        whole, long = rank >= 0, (rank < 0) & (bytes_of > WINDOW)
        short = ~whole & ~long
        n = np.ones(len(new), np.int64)
        starts = np.empty(len(new), np.int64)
        tokens, n[short] = self._contract([new[i] for i in np.flatnonzero(short).tolist()])
        starts[short] = np.cumsum(n[short]) - n[short]
        some = [tokens, rank[whole]]
        starts[whole] = len(tokens) + np.arange(whole.sum())
        some += self.contract([new[i] for i in np.flatnonzero(long).tolist()])
        n[long] = [len(x) for x in some[2:]]
        starts[long] = len(tokens) + whole.sum() + np.cumsum(n[long]) - n[long]
        self.starts = np.r_[self.starts, starts + len(self.tokens)]
        self.tokens = np.concatenate([self.tokens, *some])
        self.sizes, self.met = np.r_[self.sizes, n], np.r_[self.met, np.zeros(len(new), np.int64)]
        self.remembered += int(bytes_of.sum())

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> Iterator[list[np.ndarray]]:
        """The tokens of texts, some texts at a time."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= SLICE):
                chars += len(texts[end] or "")
                end += 1
            yield [np.concatenate(x) if len(x) != 1 else x[0] for x in self._slice(texts[at:end], pattern)]
            at = end

    def _slice(self, texts: list[str | None], pattern: regex.Pattern) -> list[list[np.ndarray]]:
        """For each text its tokens in blocks; the blocks of a long text are encoded one after the other."""
        short = [pattern.findall(t) if t and len(t) <= SLICE else [] for t in texts]
        out = [[x] for x in self._numbers(short)]
        for i, t in enumerate(texts):
            if t and len(t) > SLICE:
                out[i] = [self._numbers([words])[0] for words in blocks(t, pattern)]
        return out

    def _numbers(self, words: list[list[str]]) -> list[np.ndarray]:
        """The tokens of texts that are cut into words."""
        if len(self.words) > REMEMBERED or self.remembered > REMEMBERED_BYTES:
            self._forget()
        length = np.cumsum([0, *map(len, words)])
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), np.int64, length[-1])
        if self.words.new:
            self._learn()
        self.met += np.bincount(which, minlength=len(self.met))
        n = self.sizes[which]
        flat = self.tokens[self._range(self.starts[which], n)]
        cuts = np.r_[0, np.cumsum(n)][length]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of texts given as lists of ids."""
        at = lists.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(at))
        out: list[list[str]] = [[] for _ in range(len(lists))]
        for k in range(0, len(flat), CHUNK_TOKENS):
            part = slice(k, k + CHUNK_TOKENS)
            self.con.register("tokens", pa.table({"doc": doc[part], "position": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            found = self.con.sql(_DECODE).to_arrow_table()
            self.con.unregister("tokens")
            for d, x in zip(found["doc"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[d].append(x)
        return ["".join(x).encode("latin-1") for x in out]


def blocks(text: str, pattern: regex.Pattern, size: int = SLICE) -> Iterator[list[str]]:
    """The matches of ``pattern`` in a long text, in blocks of about ``size`` characters. A match that ends ``AHEAD``
    characters before the end of what was looked at is the same in the whole text; a match that is longer than a block is
    looked for in a longer one."""
    at, more = 0, size
    while at < len(text):
        end = min(len(text), at + more)
        words, stop = [], at
        for m in pattern.finditer(text, at, end):
            if end < len(text) and m.end() > end - AHEAD:
                break
            words.append(m.group())
            stop = m.end()
        else:
            stop = end if end == len(text) else max(stop, end - AHEAD)
        if stop == at:
            more *= 2
            continue
        yield words
        at, more = stop, size


_CODECS: dict[str, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """One for each Python worker and rank file: what it remembers serves later tasks."""
    digest, ranks = shared.value
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(ranks)
    return _CODECS[digest]


def _share(df: DataFrame, ranks_path: str) -> Broadcast:
    ranks = read_ranks(ranks_path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))


def _sha256(values: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())


_WANTED = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, ranks_path: str, pattern: str, wanted: tuple[str, ...] = ("ids", "n_tokens"), keep_text: bool = True) -> DataFrame:
    """``docs`` with the ``wanted`` of ids array<int>, n_tokens, decoded binary (from the ids, in the same pass) and the
    SHA-256 of both: of the decimal ids joined by one space, and of the decoded bytes.

    Null text is the empty text: no tokens. Every match of ``pattern`` is encoded by itself, special tokens are
    ordinary text. Texts of any length are encoded whole, and words of any length by the same query. Repeated rows
    give equal results; an empty table gives none. Other columns pass through (text too, unless ``keep_text`` is false);
    columns that are named like the results are replaced.
    """
    shared, spark = _share(docs, ranks_path), docs.sparkSession
    small_batches(spark)
    rest = docs.drop(*_WANTED)
    names = [c for c in rest.columns if keep_text or c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name in names]
    schema = ", ".join(fields + [f"{c} {_WANTED[c]}" for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, compiled, decimal = _codec(shared), regex.compile(pattern), None
        for b in batches:
            at = 0
            for some in codec.encode(b.column("text").to_pylist(), compiled):
                ids, out = _lists(some), {}
                out["ids"], out["n_tokens"] = ids, ids.value_lengths().cast(pa.int64())
                if "ids_sha256" in wanted:
                    decimal = pa.array([str(i) for i in range(max(codec.bytes) + 1)]) if decimal is None else decimal
                    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, decimal.take(ids.flatten())), " ")
                    out["ids_sha256"] = _sha256(joined.cast(pa.binary()).to_pylist())
                if "decoded" in wanted or "decoded_sha256" in wanted:
                    decoded = codec.decode(ids)
                    out["decoded"], out["decoded_sha256"] = pa.array(decoded, pa.binary()), _sha256(decoded) if "decoded_sha256" in wanted else None
                own = b.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([own.column(c) for c in names] + [out[c] for c in wanted], names=[*names, *wanted])
                at += len(some)

    return rest.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with decoded binary: the bytes of ids. A null list decodes to no bytes."""
    shared = _share(encoded, ranks_path)
    small_batches(encoded.sparkSession)
    keep = encoded.drop("decoded").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    names = keep.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codec.decode(b.column("ids")), pa.binary())], names=[*names, "decoded"])

    return keep.mapInArrow(run, schema)


def bpe_report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(own, ranks_path, pattern, ("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)
