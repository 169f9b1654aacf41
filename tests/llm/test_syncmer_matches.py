import hashlib
import re
from collections import Counter

import xxhash

from linespan.llm import syncmers

SCHEMA = "doc_id bigint, text string"


def matched(a, b):
    """By definition: the first positions of shared k-mers, and the Jaccard index."""
    x, y = ({}, {})
    for side, anchors in ((x, a), (y, b)):
        for r in anchors:
            side.setdefault(r.kmer, r.position)
    return sorted((x[k], y[k]) for k in x.keys() & y.keys()), len(x.keys() & y.keys()) / len(x.keys() | y.keys())


def test_all_anchors_are_matched(spark, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    base = " ".join(f"w{i * 7919 % 9973}" for i in range(4_000))
    text |= {100_000: base, 99_999: base.replace("w7 ", "x ").replace("w500 ", "y "), 99_998: "a b c d e f g " * 300}
    order = sorted(text, reverse=True)
    rows = []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        k = len(text[i]) // 3
        rows += [(i, "own", text[i]), (i, "next", text[j]), (i, "edited", text[i][: len(text[i]) - k] + text[j][:k])]
    found = syncmers.with_anchors(spark.createDataFrame(rows, "i bigint, kind string, t string"), "t", "a").collect()
    anchors = {(r.i, r.kind): r.a for r in found}
    assert len(anchors[100_000, "own"]) > 10 * syncmers.SKETCH
    out = syncmers.fingerprint_documents(spark.createDataFrame(list(text.items()), SCHEMA)).collect()
    assert len(out) == len(text)
    for r in out:
        for kind, got, near in (("edited", r.match_edited, r.near_edited), ("next", r.match_next, r.near_next)):
            assert ([tuple(x) for x in got], near) == matched(anchors[r.doc_id, "own"], anchors[r.doc_id, kind])


def mixed(values, seed=42):
    """Longs hashed one after the other."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def syncmers_plainly(text):
    """(position, hash) of the closed syncmers: windows of five words whose least pair of neighbours is the first or last."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    out = []
    for i in range(len(words) - 4):
        pairs = [mixed(words[j : j + 2]) for j in range(i, i + 4)]
        if min(pairs) in (pairs[0], pairs[3]):
            out.append((i, mixed(words[i : i + 5])))
    return out or [(0, mixed(words))]


def print_plainly(text):
    least = sorted({(k & (1 << 64) - 1) >> 32 for _, k in syncmers_plainly(text)})[: syncmers.SKETCH]
    return "".join(f"{x:08x}" for x in least)


def test_report_against_plain_python(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-5, None), (-6, ""), (-7, "one two"), (-7, "漢字" * 40), (-9, "a b c d e"), (None, "no id at all here now"), (-8, " \t\n")]
    text = [(i, t or "") for i, t in rows]
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    text.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    want = Counter()
    for (i, own), (_, after) in zip(text, text[1:] + text[:1], strict=True):
        k = len(own) // 3
        edited = own[: len(own) - k] + after[:k]
        likeness = []
        for other in (edited, after):
            a, b = ({h for _, h in syncmers_plainly(t)} for t in (own, other))
            likeness.append(len(a & b) / len(a | b))
        want[i, len(own), hashlib.sha256(edited.encode()).hexdigest(), print_plainly(own), print_plainly(edited), *likeness] += 1
    out = syncmers.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert Counter(tuple(r) for r in out.collect()) == want


def test_ranges_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 20)
    monkeypatch.setattr(syncmers, "STRIDE", 8)
    ids = [i * 37 % 1009 - 300 for i in range(1009)] + [None, None, 5, 5, 5]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], SCHEMA)
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = {(i, t): after for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)}
    assert {(r.doc_id, r.text): r.next_text for r in syncmers.with_next(df, ["text"]).collect()} == want
    bounds = [-5, 0, 1, 7, 8, 9, 100, 101, 102, 103, 104, 111, 113, 114, 200, 201, 300, 500]
    keys = list(range(-10, 520, 3))
    for stride in (1, 2, 3, 4, 9, 17, 18, 19):
        monkeypatch.setattr(syncmers, "STRIDE", stride)
        got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", syncmers._bucket(syncmers.F.col("k"), bounds).alias("b")).collect()
        assert all(r.b == sum(x <= r.k for x in bounds) for r in got)
