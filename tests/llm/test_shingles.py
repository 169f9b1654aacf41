import random

import corpus_pipeline
import pytest

from linespan.llm import shingles, simhash
from linespan.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def jaccard(a, b):
    plain = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} if t.split() else set()
    x, y = plain(a), plain(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def edited(rng, text, edits):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def near_copies(seed, groups=18):
    """Texts, some with copies in which a few words differ, on both sides of the limit."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 200, 600))))
        out += [base, *[edited(rng, base, max(1, round(len(base.split()) / part))) for part in (28, 50, 60, 80, 100)[: g % 6]]]
    return list(enumerate(out))


def joined(rows, same):
    """The least id of each row's group, by all pairs."""
    group, changed = {i: i for i, _ in rows}, True
    pairs = [(i, j) for i, a in rows for j, b in rows if i != j and same(i, a, j, b)]
    while changed:
        changed = False
        for i, j in pairs:
            if group[j] < group[i]:
                group[i], changed = group[j], True
    return group


def groups_of(rows):
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    return joined(rows, lambda i, a, j, b: jaccard(a, b) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 3)


def test_stage_joins_near_copies_beyond_three_bits(spark):
    rows = near_copies(1)
    far = [(i, j) for i, a in rows for j, b in rows if i < j and jaccard(a, b) >= 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3]
    assert len(far) > 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, None).collect()} == set(groups_of(rows).values())


@pytest.mark.parametrize("group", [shingles.GROUP, 1_000])
def test_links_are_all_pairs_of_the_likeness(spark, monkeypatch, group):
    monkeypatch.setattr(shingles, "GROUP", group)
    rows = [*near_copies(2), (900, ""), (901, None), (902, "two words"), (903, "TWO  words"), (None, "two words"), (904, "two words"), (904, "two words"), (904, "some more words than there are in a shingle")]
    links = shingles.alike(spark.createDataFrame(rows, "doc_id bigint, text string"))
    text = {i: t or "" for i, t in rows}
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(jaccard(text[a], text[b]) >= 0.8 for a, b in pairs if 904 not in (a, b))
    got = {r.node: r.component for r in components(links).collect()}
    want = joined([(i, t or "") for i, t in rows if i is not None and i != 904] + [(904, "two words")], lambda i, a, j, b: jaccard(a, b) >= 0.8)
    assert {i: got.get(i, i) for i in want} == want
    assert shingles.alike(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_linked_reaches_over_others():
    hashes = lambda *r: shingles.np.array(sorted(r), dtype="u8")
    sets = [hashes(*range(0, 20)), hashes(*range(50, 70)), hashes(*range(2, 22)), hashes(*range(4, 24)), hashes(*range(51, 71))]
    assert sorted(tuple(sorted(x)) for x in shingles.linked(sets)) == [(0, 2), (1, 4), (2, 3)]
