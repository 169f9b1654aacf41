import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from linespan.llm import bpe, chat, line_dedup, mixing, sharding, simhash, syncmers

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- byte-level BPE


def test_bpe_is_what_the_library_makes(spark, odd, none, docs):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    hard = spark.createDataFrame([(100, "a" * 3000), (101, " " * 900 + "x"), (102, "<|endoftext|>"), (103, "it's\r\n\t  ok 　x\x85y"), (104, "ab" * 700)], "doc_id bigint, text string")
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text"), hard):
        got = Counter(tuple(r) for r in bpe.bpe_report(df, RANKS, PATTERN).collect())
        want = Counter()
        for i, t in texts(df):
            ids = lib.encode_ordinary(t or "")
            want[i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
        assert got == want
    assert bpe.bpe_report(none, RANKS, PATTERN).count() == 0


def test_bpe_round_trip_by_itself(odd):
    out = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS)
    assert {"shard", "score", "ids", "n_tokens", "decoded"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def letters(n, length, low, high, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(map(chr, x)) for x in rng.integers(low, high, (n, length)).tolist()]


@pytest.mark.parametrize("words", [letters(20_000, 60, 0x4E00, 0x9FA5), letters(20_000, 200, 97, 123), letters(1, 300_000, 97, 123), letters(300, 1000, 0x20, 0x3000)], ids=["characters", "letters", "one word", "mixed"])
def test_bpe_of_words_without_blanks(codec, library, words):
    got = [x for some in codec.encode(words, regex.compile(PATTERN)) for x in some]
    assert [x.tolist() for x in got] == library.encode_ordinary_batch(words, num_threads=4)
    assert codec.decode(bpe._lists(got)) == [w.encode() for w in words]


def test_bpe_of_runs(codec, library):
    words = ["!" + "=" * n for n in (10, 100, 1000, 50_000)] + ["abc" * n for n in (10, 9000)] + [" " * 20_000, "aaa" + "ab" * 5000, "\n" * 777, "\x00" * 99, "ha" * 9999]
    got = [x for some in codec.encode(words, regex.compile(PATTERN)) for x in some]
    assert [x.tolist() for x in got] == library.encode_ordinary_batch(words)


def test_bpe_windows_hold_what_the_query_alone_gives(codec):
    words = [b" international", b"a" * 70, b"ab" * 50, "漢字かな".encode() * 9, b" zzzqqqxxx", bytes(range(256)), b"x", b""]
    alone = [x.tolist() for x in codec.contract(words, 1000)]
    for window in (2, 3, 7, 32):
        assert [x.tolist() for x in codec.contract(words, window)] == alone


def test_bpe_bounds_rounds_and_memory(codec, monkeypatch):
    words = [w.encode() for w in letters(40, 500, 97, 123)]
    alone = [x.tolist() for x in codec._contract(words)]
    monkeypatch.setattr(bpe, "CELLS", 3000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1000)
    assert [x.tolist() for x in codec._contract(words)] == alone
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["a few words here", "and other words there", "a few words here"] * 3
    assert codec.decode(bpe._lists([x for some in codec.encode(texts, regex.compile(PATTERN)) for x in some])) == [t.encode() for t in texts]


def test_bpe_blocks_of_a_long_text():
    r = regex.compile(PATTERN)
    text = "it's  we'll\n\n " + " ".join(letters(200, 9, 97, 123)) + "  " * 400 + "x" * 900 + " '" + "12 " * 300 + "  "
    for size in (1, 2, 70, 71, 100, 333, 5000, 10**6):
        assert [w for some in bpe.blocks(text, r, size) for w in some] == r.findall(text)
    assert list(bpe.blocks("", r)) == []


def test_batches_to_python_are_bounded_by_bytes(spark):
    wide = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    bpe.small_batches(spark)
    sizes = [r.n for r in wide.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    assert sum(sizes) > 400 << 20 and max(sizes) < 40 << 20


# --- line dedup


def dedup_plainly(rows):
    held = defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(line_dedup.BLANKS))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    held[key(x)].add(i)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or hot.get(key(x), i) == i]
        out[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    return out


def test_line_dedup(odd, none, docs):
    for df in (odd, docs):
        assert Counter(tuple(r) for r in line_dedup.dedup_report(df).collect()) == dedup_plainly(texts(df))
    whole = line_dedup.dedup_lines(odd)
    assert len(set(whole.columns)) == len(whole.columns) and whole.where("kept_text = 'k'").count() == 0
    assert line_dedup.dedup_report(none).count() == 0
    assert [r.n_dropped for r in line_dedup.dedup_report(odd.where("doc_id = 5")).collect()] == [0]


def test_line_index_is_reversible(spark, odd):
    base = odd.where("doc_id IN (1, 2, 3, 4)").select("doc_id", "text")
    more = odd.where("doc_id = 5").select("doc_id", "text")
    state = line_dedup.LineIndex().insert(base)
    dropped = lambda s, d: {r.doc_id: r.n_dropped for r in s.apply(d).collect()}
    assert set(dropped(state, base).values()) == {0}
    both = state.insert(more)
    after = dropped(both, base.unionByName(more))
    assert after == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0}
    assert dropped(both.delete(more), base) == dropped(state, base)
    assert dropped(both.delete(spark.createDataFrame([(777,)], "doc_id bigint")), base.unionByName(more)) == after
    assert both.insert(more).refs.count() == both.refs.count()


def held(state):
    """Keys that the stored filters hold, by number."""
    out = 0
    for r in state.kept.collect():
        f = line_dedup.CuckooFilter.from_bytes(bytes(r["filter"]))
        out += int(np.count_nonzero(f.table)) + len(f.overflow)
    return out


def test_stored_filters_follow_inserts_and_deletes(spark, docs, monkeypatch):
    base = docs.select("doc_id", "text")
    first, second = base.where("doc_id % 2 = 0"), base.where("doc_id % 2 = 1")
    decisions = lambda s: Counter((r.doc_id, r.n_dropped, r.kept_text) for r in s.apply(base).collect())
    one = line_dedup.LineIndex().insert(first)
    both = one.insert(second)
    again = both.delete(second)
    rebuilt = line_dedup.LineIndex(both.refs)
    assert held(both) == held(rebuilt) == both.eligible().count() > held(one) == held(again) == one.eligible().count() > 0
    assert decisions(again) == decisions(one) and decisions(both) == decisions(rebuilt)
    assert {(r.doc_id, r.n_dropped) for r in both.apply(base).collect()} == {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(base).collect()}
    assert held(again.delete(first)) == 0
    # a changed document's old lines are taken back
    line = "one more line that is long enough to be judged by its key"
    five = spark.createDataFrame([(i, line) for i in range(5)], "doc_id bigint, text string")
    state = line_dedup.LineIndex().insert(five)
    assert held(state) == 1
    state = state.insert(spark.createDataFrame([(3, "other")], "doc_id bigint, text string"))
    assert held(state) == 0 and state.eligible().count() == 0
    # an overflowing filter is built anew
    monkeypatch.setattr(line_dedup, "OVERFLOW", -1)
    assert held(one.insert(second)) == held(both)


def test_line_dedup_by_shard(docs, monkeypatch):
    want = Counter(tuple(r) for r in line_dedup.dedup_report(docs).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "GROUP_LINES", 50)
    assert Counter(tuple(r) for r in line_dedup.dedup_report(docs).collect()) == want


def test_clashing_names_come_out_as_they_were(spark):
    inner = ["_doc", "_row", "_gone", "_source", "_whole", "_rest", "_blocks", "_last", "_N", "_s", "_b", "_left", "_reads", "_key", "_range", "_in", "_top", "_to", "_to_own", "_pieces"]
    line = "one line that is long enough to be judged by its key"
    df = spark.createDataFrame([(i, f"{line}\nown {i}", "a", *[f"{c}{i}" for c in inner]) for i in range(6)], ["doc_id", "text", "source", *inner])
    for out in (line_dedup.dedup_lines(df), mixing.mix(df), syncmers.with_next(df, ["text"]), bpe.encode(df, RANKS, PATTERN)):
        rows = out.collect()
        assert {r.doc_id for r in rows} == set(range(6)) and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in inner)
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(df).collect()) == 5


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64))
    f = line_dedup.CuckooFilter(len(keys))
    f.insert_all(keys)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01
    for k in keys[:2_500]:
        assert f.delete(int(k))
    assert f.contains(keys[2_500:]).all() and f.contains(keys[:2_500]).mean() < 0.01
    small = line_dedup.CuckooFilter(1)
    for _ in range(20):
        small.insert(7)
    assert sum(small.delete(7) for _ in range(25)) == 20
    assert not line_dedup.CuckooFilter(0).contains(keys).any()


# --- SimHash


def print_of(t):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(odd, none, docs):
    for df in (odd, docs):
        rows = texts(df)
        prints = [print_of(t) if len(t or "") < 9_000 else simhash.fingerprint(t) for _, t in rows]
        near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3 or (rows[i][0] == rows[j][0] is not None)]
        group = joined(len(rows), near)
        least = {}
        for g, (i, _) in zip(group, rows, strict=True):
            least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
        want = Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True))
        assert Counter(tuple(r) for r in simhash.simhash_report(df).collect()) == want
    assert simhash.simhash_report(none).count() == 0


@pytest.mark.parametrize(("n", "exact"), [(0, 16), (1, 16), (900, 16), (400, 0)])
def test_trie_join(n, exact):
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    codes = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(m) << rng.integers(0, 60, n).astype(np.uint64)) for m in (1, 5, 7, 9))]))
    links = [(i, j) for i in range(len(codes)) for j in i + 1 + np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1 :]) <= 3) if not exact or codes[i] >> np.uint64(64 - exact) == codes[j] >> np.uint64(64 - exact)]
    assert list(simhash.trie_join(codes, exact)) == joined(len(codes), links)


@pytest.mark.parametrize("blocks", [None, 5, 6])
def test_hot_blocks_are_split_without_loss(spark, monkeypatch, blocks):
    assert [simhash.blocks_for(n) for n in (0, 10**8, 10**10, 10**12)] == [4, 4, 5, 6]
    monkeypatch.setattr(simhash, "HOT", 8)
    codes = [x for x in range(64)] + [x << 40 for x in range(1, 40)] + [-1 << k for k in range(1, 64, 7)] + [(-1 << k) ^ 0x8100 for k in range(20, 64, 5)]
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp bigint, rep bigint")
    from linespan.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(classes, blocks)).collect()}
    want = joined(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if bin((codes[i] ^ codes[j]) & (1 << 64) - 1).count("1") <= 3])
    assert [got.get(i, i) for i in range(len(codes))] == want


def test_components(spark):
    from linespan.llm.components import components

    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 160)] + [tuple(map(int, rng.integers(300, 340, 2))) for _ in range(25)] + [(5, 5), (None, 1), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = joined(400, [(a, b) for a, b in edges if a is not None])
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- syncmers


def test_syncmer_pairs_and_edits(odd, none, docs):
    for df in (odd, docs):
        rows = [(i, t or "") for i, t in texts(df)]
        out = syncmers.fingerprint_documents(df).collect()
        assert len(out) == len(rows)
        order = sorted({i for i, _ in rows if i is not None}, reverse=True)
        if len({i for i, _ in rows}) == len(rows):
            text = dict(rows)
            after = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
            for r in out:
                t, k = text[r.doc_id], len(text[r.doc_id]) // 3
                assert r.n_chars == len(t) and r.edited_sha256 == sha(t[: len(t) - k] + text[after[r.doc_id]][:k])
        assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
        prints = defaultdict(set)
        ids = {i: t for i, t in rows}
        for r in out:
            if r.doc_id is not None:
                prints[ids[r.doc_id]].add(r.fingerprint)
        assert all(len(v) == 1 for v in prints.values())
    assert syncmers.fingerprint_documents(none).count() == 0
    one = syncmers.fingerprint_documents(odd.where("doc_id = 1")).collect()[0]
    assert one.near_next == 1.0


def test_syncmer_likeness_follows_the_texts(docs):
    out = syncmers.fingerprint_documents(docs).where("n_chars > 2000").collect()
    assert 0.35 < np.mean([r.near_edited for r in out]) < 0.65
    assert np.mean([r.near_next for r in out]) < 0.1


def test_syncmers_by_definition(spark):
    words = [f"w{i * 7919 % 101}" for i in range(80)]
    df = spark.createDataFrame([(" ".join(words),), ("only three words",), ("",)], "t string")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = df.select("t", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"))
    hashes = own.collect()[0].h
    assert hashes[0] == signed(xxhash.xxh64_intdigest(words[0].encode(), 42))
    pair = [r[0] for r in spark.createDataFrame(list(zip(hashes, hashes[1:], strict=False)), "a bigint, b bigint").select(F.xxhash64("a", "b")).collect()]
    want = [i for i in range(len(words) - 4) if min(pair[i : i + 4]) in (pair[i], pair[i + 3])]
    got = syncmers.with_anchors(df, "t", "a").collect()
    assert [x.position for x in got[0].a] == want
    assert len(got[1].a) == len(got[2].a) == 1
    moved = syncmers.with_anchors(spark.createDataFrame([("x y z " + " ".join(words),)], "t string"), "t", "a").collect()[0].a
    assert {x.kmer for x in got[0].a} <= {x.kmer for x in moved}


# --- sharding


def test_sharding(odd, none, docs):
    for df in (odd, docs):
        out = sharding.shard_documents(df).collect()
        want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
        slots = defaultdict(list)
        by_id = defaultdict(set)
        for r in out:
            slots[r.shard].append(r.slot)
            by_id[r.doc_id].add((r.shard, r.grown_shard))
            assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) and r.law == "key"
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for v in by_id.values())
    assert sharding.shard_documents(none).count() == 0


def test_sharding_by_weight(spark):
    tree = sharding.Tree((((((0, 1.0), (1, 3.0)),)), (((2, 2.0),), ((3, 2.0),))))
    df = spark.range(40_000).select(F.col("id"), sharding.assign(F.col("id"), tree).alias("s"), sharding.assign(F.col("id"), tree.grow(2.0)).alias("g"))
    share = {r.s: r["count"] / 40_000 for r in df.groupBy("s").count().collect()}
    assert all(abs(share[s] - w / 8) < 0.01 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    moved = df.where("s <> g")
    assert {r.g for r in moved.select("g").distinct().collect()} == {4} and abs(moved.count() / 40_000 - 0.2) < 0.01
    heavier = sharding.Tree((((((0, 1.0), (1, 3.0)),)), (((2, 4.0),), ((3, 2.0),))))
    into = df.withColumn("h", sharding.assign(F.col("id"), heavier)).where("s <> h").select("s", "h").distinct().collect()
    assert all(r.h in (2, 3) for r in into) and not any(r.h == 3 and r.s == 2 for r in into)
    with pytest.raises(ValueError):
        sharding.Tree.even(0)


# --- mixing


def mix_plainly(rows, limit=mixing.REPEAT_LIMIT):
    """How often a source is read, from its token counts alone."""
    total = Counter()
    for _, t, s in rows:
        total[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    full = {s: n for s, n in total.items() if n}
    low, high = 0.0, 1.0
    spread = max(full.values()) / min(full.values())
    if spread <= limit:
        high = 0.0
    for _ in range(60 if high else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if spread ** (1 - mid) <= limit else (mid, high)
    weight = {s: n**high for s, n in full.items()}
    least = min(weight[s] / full[s] for s in full)
    return {s: weight[s] / full[s] / least if s in full else 1.0 for s in total}, total


def test_mixing(odd, none, docs):
    for df in (odd, docs):
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        epochs, total = mix_plainly(rows)
        out = mixing.mix_report(df).collect()
        read = Counter()
        for r in out:
            read[r.source] += r.n_tokens
        longest = Counter()
        for _, t, s in rows:
            longest[s] = max(longest[s], len((t or "").split()))
        for s in total:
            assert -1e-3 <= read[s] - epochs[s] * total[s] <= longest[s] + 1e-3
            assert 1 - 1e-9 <= epochs[s] <= mixing.REPEAT_LIMIT + 1e-6
        times = Counter(r.doc_id for r in out)
        known = Counter(i for i, _, _ in rows)
        assert set(times) == set(known) and all(n >= known[i] for i, n in times.items())
        last = defaultdict(list)
        for r in out:
            last[r.source, r.epoch].append((r.block_key, r.doc_key))
        assert all(e in (1, 2, 3) for _, e in last)
    assert mixing.mix_report(none).count() == 0


def test_mixing_partial_epoch_is_a_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    rows = [(i, "w " * (1 + i % 5), "big" if i % 4 else "small") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df, mixing.Target(repeat=1.5)).collect()
    again = [r for r in out if r.source == "small" and r.epoch == 2]
    order = mixing.mix(df, mixing.Target(repeat=None, entropy=1.0, budget=5e4)).where("source = 'small' AND epoch = 2").orderBy("block_key", "doc_key").collect()
    assert 0 < len(again) < 50
    assert {r.doc_id for r in again} == {r.doc_id for r in order[: len(again)]}


def test_mixing_entropy(spark):
    import math

    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, total bigint")
    a = mixing.exponent(sizes, mixing.Target(entropy=0.9))
    w = [n**a for n in (1000, 100, 10)]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert abs(h / math.log(3) - 0.9) < 1e-6
    assert mixing.exponent(sizes, mixing.Target(entropy=1.0)) < 1e-6


# --- chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, 5, "ann", "n"), (1, None, "bob", "late")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"mask": F.lit("clash"), "start": F.lit(1)})
    out = chat.rotate(df)
    got = {(r.conv_id, r.perspective): (r.text, [tuple(s) for s in r.spans]) for r in chat.render(out).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    text, spans = got[1, "ann"]
    assert text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|end|\\><|end|>\n<|user name=bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n<|user name=bob|>\nlate<|end|>\n"
    assert [text[a:b] for a, b in spans] == ["hi <\\|end|\\><|end|>\n", "<|end|>\n", "<|end|>\n"]
    text, spans = got[1, "bob"]
    assert [text[a:b] for a, b in spans] == ["yo<|end|>\n", "late<|end|>\n"]
    assert "<|user name=ann|>" in text
    assert chat.rotate(df.limit(0)).count() == 0


def test_perspectives_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), None if t > 40 else int(t), ["ann", "bob", "system", "cy", None][r], "x" * int(n) + "<|") for c, t, r, n in zip(rng.integers(0, 4, 600), rng.integers(-3, 45, 600), rng.integers(0, 5, 600), rng.integers(0, 4, 600), strict=True)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = defaultdict(list)
    for r in chat.rotate(df).collect():
        got[r.conv_id, r.perspective].append(r)
    assert set(got) == {(c, s or "unknown") for c, _, s, _ in rows if s != "system"}
    for (conv, who), segments in got.items():
        segments.sort(key=lambda r: r.start)
        assert Counter((r.turn, r.speaker, r.body) for r in segments) == Counter((t, s or "unknown", b.replace("<|", "<\\|")) for c, t, s, b in rows if c == conv)
        turns = [1 << 62 if r.turn is None else r.turn for r in segments]
        assert turns == sorted(turns) and segments[0].start == 0
        assert all(a.end == b.start for a, b in zip(segments, segments[1:], strict=False))
        assert all(r.end - r.start == len(r.head + r.body + r.tail) and r.mask == (r.speaker == who) == (r.head == "<|assistant|>\n") for r in segments)


def test_perspectives_of_a_long_conversation(spark):
    df = spark.range(3_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    rows = chat.rotate(df).where("perspective = 'a'").orderBy("turn").collect()
    assert len(rows) == 3_000 and rows[0].start == 0
    assert all(a.end == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.end - r.start == len(r.head + r.body + r.tail) and r.mask == (r.speaker == "a") for r in rows)


def test_chat_against_driver_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    want = duckdb.sql(f"WITH s AS (SELECT DISTINCT conv_id, role AS p FROM '{path}' WHERE role <> 'system') SELECT count(*), sum((role = p)::INT) FROM '{path}' JOIN s USING (conv_id)").fetchall()[0]
    out = chat.rotate(spark.read.parquet(path)).agg(F.count(F.lit(1)), F.sum("mask")).first()
    assert tuple(out) == tuple(want)
