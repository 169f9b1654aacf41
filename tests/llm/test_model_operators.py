from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linespan.llm import embedding_dedup, langid, toxicity
from linespan.llm.common import held_out

# --- language ID


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, language_model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, language_model).where(held_out(F.col("doc_id"), 3, 1))
    n, right = out.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97


def test_language_odd_rows(odd, none, language_model):
    rows = langid.predict(odd, language_model).collect()
    assert len(rows) == odd.count() and len(set(rows[0].__fields__)) == len(rows[0])
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters) and 0 <= r.score <= 1
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 10}) == 1
    out = langid.language_report(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
    assert langid.language_report(none).count() == 0
    alone = langid.language_report(odd.where("doc_id = 2").withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]


def test_gradients():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(3)
    m = langid._new(["a", "b", "c"], rng)
    m.x, m.u, m.v, m.c = (w.astype(np.float64) for w in m.weights)
    data = rng.integers(97, 100, (5, 9)).astype(np.uint8)
    mask = np.ones((5, 9), bool)
    mask[1, 6:] = mask[4, 2:] = False
    label = np.array([0, 1, 2, 1, 0])
    _, grads = langid._step(m, data, mask, label)
    for w, g in zip(m.weights, grads, strict=True):
        live = np.flatnonzero(np.abs(g.reshape(-1)) > 1e-4)
        for k in rng.choice(live, min(8, len(live)), replace=False):
            flat = w.reshape(-1)
            was, e = flat[k], 1e-3
            flat[k] = was + e
            up, _ = langid._step(m, data, mask, label)
            flat[k] = was - e
            down, _ = langid._step(m, data, mask, label)
            flat[k] = was
            assert abs((up - down) / (2 * e) - g.reshape(-1)[k]) < 2e-3 + 0.05 * abs(g.reshape(-1)[k])


def test_reading_in_blocks_is_the_same(language_model):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 500)]
    reader = langid.Reader(language_model)
    data, mask, which = langid.windows(texts)
    states = langid._states(language_model, data, mask)
    p = np.exp(np.concatenate([states[0], states[1]], -1) @ language_model.v + language_model.c)
    p = (p / p.sum(-1, keepdims=True)) * mask.T[..., None]
    want = np.zeros((len(texts), p.shape[-1]))
    np.add.at(want, which, p.sum(0))
    got = reader.pooled(texts)
    assert np.allclose(got, want / np.maximum(1, [len(t) for t in texts])[:, None], atol=1e-4)
    assert len(reader.positions(texts[5])) == 500 and len(reader.positions(b"")) == 0
    assert np.allclose(got[1:].sum(1), 1, atol=1e-4)


# --- toxicity


def _made(n=700, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(rng.integers(20, 60))]
        if i % 4 == 0:
            for _ in range(2):
                words[rng.integers(len(words))] = ("grumpf", "snarlish.", "snarling", "BLEH!")[rng.integers(4)]
        rows.append((" ".join(words), int(i % 4 == 0), ("en", "de")[i % 2]))
    return rows


def test_toxicity_learns_and_calibrates():
    m = toxicity.train(_made())
    held = _made(300, seed=9)
    s = toxicity.Reader(m).scores([t for t, _, _ in held])
    truth = np.array([y for _, y, _ in held])
    assert ((s >= 0.3) == truth).mean() > 0.97
    assert toxicity.Reader(m).scores(["all fine here", "", "you snarler"]).round(3).tolist()[0] < 0.3
    many = toxicity.Reader(m)
    assert np.allclose(many.scores([held[0][0]] * 3), s[0])


def test_toxicity_reads_whole_texts(monkeypatch):
    m = toxicity.train(_made())
    text = "w1 w2 w3 " * 50 + "grumpf snarling " + "w4 w5 " * 50
    whole = toxicity.Reader(m).scores([text, "w1", text])
    monkeypatch.setattr(toxicity, "CHUNK", 20)
    assert np.allclose(toxicity.Reader(m).scores([text, "w1", text]), whole, atol=1e-6)
    monkeypatch.setattr(toxicity, "REMEMBERED", 1)
    reader = toxicity.Reader(m)
    assert np.allclose([reader.scores([t])[0] for t in (text, "w1", text)], whole, atol=1e-6)


def test_toxicity_scores_against_plain_loops():
    """Every window of every filter, one after the other; behind the last word stand zeros."""
    m = toxicity.train(_made())
    texts = ["", "grumpf", "w1 w2", "unknown words only here", *[t for t, _, _ in _made(40, seed=5)]]
    want = []
    for t in texts:
        words = [m.table[toxicity.rows_of(w)].sum(0) for w in t.lower().split()]
        logit = float(m.out_bias[0])
        for i, f in enumerate(m.filters):
            for k in range(toxicity.FILTERS):
                values = [sum(float(words[at + j] @ f[j, :, k]) for j in range(len(f)) if at + j < len(words)) for at in range(max(1, len(words)))]
                logit += max(0.0, max(values) + float(m.bias[i * toxicity.FILTERS + k])) * float(m.out[i * toxicity.FILTERS + k])
        want.append(1 / (1 + np.exp(-np.clip(logit - m.shift + np.log(0.3 / 0.7), -40, 40))))
    assert np.allclose(toxicity.Reader(m).scores(texts), want, atol=1e-4)


def test_toxicity_gradients():
    """Against differences of the loss, in doubles."""
    rng = np.random.default_rng(2)
    words = toxicity.Words()
    docs = [words.of(t.split()) for t in ("a bb grumpfen c", "snarl a", "c c bb dddddd eeeeeee", "")]
    rows = np.array(words.rows)
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS) / 9, np.zeros(1))
    m.table[0] = 0
    laid, truth, weight = toxicity._lay_out(docs), np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.7, 1.3, 1.0, 0.5])
    _, grads, used = toxicity._gradients(m, rows, *laid, truth, weight)
    params = {"out": m.out, "out_bias": m.out_bias, "bias": m.bias} | {f"f{i}": f for i, f in enumerate(m.filters)}
    tried = [(params[n], i, grads[n][i]) for n in params for i in [tuple(rng.integers(0, params[n].shape)) for _ in range(6)]]
    tried += [(m.table, (used[r], c), grads["table"][r, c]) for r in rng.integers(1 if used[0] == 0 else 0, len(used), 12) for c in rng.integers(0, toxicity.DIM, 2)]
    for array, at, got in tried:
        was, losses = array[at], []
        for step in (1e-5, -1e-5):
            array[at] = was + step
            losses.append(toxicity._gradients(m, rows, *laid, truth, weight)[0])
        array[at] = was
        assert abs((losses[0] - losses[1]) / 2e-5 - got) < 1e-5
    assert any(abs(g) > 1e-4 for _, _, g in tried)


def test_toxicity_finds_the_held_out(spark):
    """On the driver's documents, in the fold that nothing is learned from."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.toxicity_report(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    assert len(out) > 500 and np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert np.mean([r.predicted for r in out if r.toxic]) >= 0.9


def test_toxicity_odd_rows(spark, odd, none, labels):
    out = toxicity.toxicity_report(odd, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.toxicity_report(none, labels).count() == 0
    one = toxicity.toxicity_report(odd, labels.where("toxic = 7")).collect()
    assert len({r.score for r in one}) == 1 and one[0].predicted == 0
    assert {r.held_out for r in out} == {True, False}


def test_toxicity_never_learns_from_the_test_fold(spark):
    docs = spark.createDataFrame([(i, f"x{i}", "en") for i in range(50)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, toxic int")
    seen = []
    original, toxicity.train = toxicity.train, lambda rows: seen.extend(rows)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = original
    held = {r.text for r in docs.where(held_out(F.col("doc_id"), 4, 2)).collect()}
    assert seen and held and not held & {t for t, _, _ in seen}


def test_toxicity_learns_from_every_row(spark, monkeypatch):
    """However many there are, and however long."""
    rows = [(i, f"x{i}", int(i % 9 == 0)) for i in range(5000)] + [(5001, "long " * 6000, 1), (5003, "", 0), (5004, None, 1), (5005, "twice", 0), (5005, "twice", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, y) for i, _, y in {r[0]: r for r in rows}.values()], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", seen.extend)
    toxicity.fit(docs, labels)
    out = {r.doc_id for r in docs.where(held_out(F.col("doc_id"), 4, 2)).collect()}
    assert Counter((t, y) for t, y, _ in seen) == Counter((t, y) for i, t, y in rows if i not in out and t is not None)


def _shards(rows, n, most):
    batch = toxicity.pa.RecordBatch.from_pylist([dict(zip(("shard", "doc_id", "text", "toxic", "lang"), r, strict=True)) for r in rows])
    before, toxicity.SHARD = toxicity.SHARD, most
    try:
        return list(toxicity.Shard.of(toxicity._packed(iter([batch]), n)))
    finally:
        toxicity.SHARD = before


def test_toxicity_shards_hold_all():
    """Each text with each of its id's labels; texts let through without a label are not learned."""
    rows = [(0, 1, None, 0, None), (0, 1, None, 1, None), (0, 1, "a b", None, "en"), (0, 2, "no label", None, "en"), (1, 3, None, 1, None)]
    rows += [(1, 3, f"c{k} d", None, None) for k in range(5)] + [(1, 4, None, 0, None), (1, 4, "", None, "de"), (2, 5, None, 1, None), (3, 6, "no label", None, None)]
    got = _shards(rows, 4, (1, 1000))
    assert [(s.number, len(s.docs), s.truth.tolist(), s.languages) for s in got] == [(0, 2, [0, 1], ["en", "en"]), (1, 2, [1, 1], [None] * 2), (5, 2, [1, 1], [None] * 2), (9, 2, [1, 0], [None, "de"])]
    words = toxicity.rows_of("c4"), toxicity.rows_of("d")
    assert [tuple(r) for r in got[-1].rows[got[-1].docs[0]]] == [tuple(w) for w in words] and len(got[-1].docs[1]) == 0


def test_toxicity_learns_in_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ON_DRIVER", (0, 0))
    monkeypatch.setattr(toxicity, "SHARD", (250, 1 << 20))
    monkeypatch.setattr(toxicity, "STEPS", 80)
    made = _made(1200)
    docs = spark.createDataFrame([(i, t, g) for i, (t, _, g) in enumerate(made)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(made)], "doc_id bigint, toxic int")
    m, again = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(5), labels.repartition(3))
    held = _made(300, seed=9)
    s = toxicity.Reader(m).scores([t for t, _, _ in held])
    assert ((s >= 0.3) == np.array([y for _, y, _ in held])).mean() > 0.95
    assert set(m.by_language) == {"en"}  # of the other language none is toxic
    assert np.array_equal(m.table, again.table) and np.array_equal(m.out, again.out) and (m.shift, m.by_language) == (again.shift, again.by_language)
    out = {r.doc_id for r in docs.where(held_out(F.col("doc_id"), 4, 2)).collect()}
    uses = Counter(r for i, (t, _, _) in enumerate(made) if i not in out for r in {r for w in t.lower().split() for r in toxicity.rows_of(w)} - {0})
    assert set(np.flatnonzero(m.table.any(1))) == {r for r, k in uses.items() if k >= toxicity.RARE}
    clean = toxicity.fit(docs, labels.where("toxic = 0"))
    assert len({*toxicity.Reader(clean).scores(["grumpf", "", "w1"])}) == 1


def test_toxicity_learns_from_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    m = toxicity._new(rng)
    m.table[1:] = rng.normal(size=m.table[1:].shape)
    rows = np.concatenate([np.zeros((1, 4), int), rng.integers(1, toxicity.BUCKETS, (60, 4))])
    docs = [rng.integers(1, 61, n).astype(np.int32) for n in (0, 1, 2, 19, 20, 21, 22, 23, 38, 200, 5)]
    whole = toxicity._windows(m, rows, *toxicity._lay_out(docs))
    monkeypatch.setattr(toxicity, "CHUNK", 20)
    top, won = toxicity._read(m, rows, docs)
    assert np.allclose(top, whole[0], atol=1e-5) and all(np.array_equal(a, b) for a, b in zip(won, whole[1], strict=True))


def test_toxicity_hashes_words_together(monkeypatch):
    """Rows of many words at once are those of each; only very long words are hashed singly."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgäß漢é.,!\"'…\U0001f600\U00010000\x00İ\u0301"))
    words = ["".join(rng.choice(letters, n)) for n in rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 39, 40, 41, 90], 3000)]
    words += ["", "...", "x" * 40, "漢" * 40, "\U0001f600" * 40, "\U0001f600" * 41, "é" * 6]
    want = [toxicity.rows_of(w) for w in words]
    assert toxicity.all_rows_of(words).tolist() == want and toxicity.all_rows_of([]).shape == (0, 4)
    assert toxicity.all_rows_of([*words, "\ud800a"]).tolist() == [*want, toxicity.rows_of("\ud800a")]
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    assert toxicity.all_rows_of(words).tolist() == want
    m, single = toxicity._new(rng), []
    monkeypatch.setattr(toxicity, "rows_of", lambda w, f=toxicity.rows_of: single.append(w) or f(w))
    texts = [" ".join(f"w{k}x{i}" for k in range(50)) for i in range(20)] + ["y" * 41]
    toxicity.Reader(m).scores(texts)
    known = toxicity.Words()
    assert [known.of(t.split()).tolist() for t in texts] and len(known.rows) == 1002
    assert single == ["y" * 41] * 2


def test_toxicity_words_are_those_of_split():
    space = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    texts = ["", "a", " a  b ", "\n", "b a b\x00", "".join(f"a{c}" for c in space), *[f"{c}x{c}y{c}" for c in space], *[f"x{chr(c)}y" for c in range(0x3100) if not 0xD800 <= c]]
    for own in (texts, texts[1:2], [""], [], ["a \ud800 a"]):
        ids, met = toxicity.numbered(own)
        met = met if isinstance(met, list) else met.to_pylist()
        assert [[met[k] for k in i] for i in ids] == [t.split() for t in own]
        words, again = toxicity.Words(), toxicity.Words()
        assert [i.tolist() for i in words.of_texts(own)] == [again.of(t.split()).tolist() for t in own] and [*words] == [*again]


# --- embeddings


def _plainly(rows, cosine=embedding_dedup.COSINE):
    unit = [embedding_dedup.unit(e) if label is not None else None for _, e, label in rows]
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and (np.array_equal(unit[i], unit[j]) or unit[i] @ unit[j] >= cosine):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for i in range(n):
        least[root(i)] = min(least[root(i)], rows[i][0])
    return Counter((rows[i][0], links[i], least[root(i)], least[root(i)] == rows[i][0]) for i in range(n))


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"cell": F.lit("clash"), "rep": F.lit(1), "ball": F.lit(2)})


def _single(x):
    return [float(np.float32(v)) for v in x]


@pytest.mark.parametrize("chunk", [1_024, 16])
def test_embeddings_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 4 * chunk)
    monkeypatch.setattr(embedding_dedup, "BALLS", 2 * chunk)
    rng = np.random.default_rng(6)
    rows = []
    for k in range(12):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), _single(centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 0.4])), k % 3))
    out = Counter(tuple(r) for r in embedding_dedup.near_duplicates(_vectors(spark, rows)).collect())
    assert out == _plainly(rows)


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (5, [1.0, 0.01], 1), (6, [1.0, 0.0], 2), (7, [1.0, 0.0], None), (8, None, 1), (10, [], 1), (11, [0.0, 0.0], 1), (12, [nan, 1.0], 1), (13, [inf, 1.0], 1), (14, [None, 1.0], 1), (15, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0], 1), (16, [-1.0, -0.0], 1), (17, [1e-30, 0.0], 1)]
    out = Counter(tuple(r) for r in embedding_dedup.near_duplicates(_vectors(spark, rows)).collect())
    assert out == _plainly(rows)
    assert embedding_dedup.near_duplicates(_vectors(spark, [])).count() == 0
    assert embedding_dedup.near_duplicates(_vectors(spark, [(1, None, 1)])).collect()[0].n_links == 0


def test_embeddings_recall(spark):
    """Pairs near the limit in many dimensions, where not every list is looked into."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        x = rng.normal(size=64)
        y = rng.normal(size=64)
        y -= x * (x @ y) / (x @ x)
        rows.append((len(rows), _single(x), 0))
        rows.append((len(rows), _single(x / np.linalg.norm(x) * 0.94 + y / np.linalg.norm(y) * (1 - 0.94**2) ** 0.5), 0))
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(_vectors(spark, rows)).collect())
    want = sum(n * k for (_, n, _, _), k in _plainly(rows).items())
    assert want >= 800 and found / want >= 0.9 and found <= want


@pytest.mark.parametrize("exact", [False, True])
def test_embeddings_recall_with_many_lists(spark, monkeypatch, exact):
    """As many lists as a table of 90 000 rows has."""
    monkeypatch.setattr(embedding_dedup, "lists_for", lambda rows: 300)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 64))
    y = x + rng.normal(size=x.shape) * rng.choice([0.1, 0.25, 0.36], (len(x), 1))
    rows = [(i, _single(v), 0) for i, v in enumerate(np.concatenate([x, y]))]
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(_vectors(spark, rows), exact=exact).collect())
    want = sum(n * k for (_, n, _, _), k in _plainly(rows).items())
    assert want >= 1_000 and (found == want if exact else 0.95 <= found / want <= 1)


def test_embeddings_without_ids_take_part(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (7, [1.0, 0.2], 1)]
    out = Counter(tuple(r) for r in embedding_dedup.near_duplicates(_vectors(spark, rows)).collect())
    assert out == Counter([(1, 2, 1, True), (None, 2, 1, True), (None, 1, None, True), (None, 1, None, True), (7, 2, 1, False)]) or out == Counter([(1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (7, 2, 1, False)])


def test_components_end_when_no_edge_changes(spark):
    from linespan.llm.components import components

    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 499), (499, 498), (7, 7), (None, 3), (900, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 498, 499: 498, 498: 498}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    from linespan.llm import common

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


def test_long_texts_are_read_in_parts(monkeypatch):
    words = [f"W{i * 7919 % 997}" for i in range(2_000)]
    text = "  " + "\n".join(words) + "\t"
    for most in (7, 100, 1_999, 2_000, 2_001):
        parts = list(toxicity.in_parts(text, most))
        assert [end for _, end in parts] == [False] * (len(parts) - 1) + [True] and max(len(p) for p, _ in parts) <= most
        whole = parts[0][0] + [w for p, _ in parts[1:] for w in p[toxicity.PAD :]]
        assert whole == [w.lower() for w in words]
    assert list(toxicity.in_parts("")) == [([], True)]


def test_codes_bound_distances():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.fit(x, 300)
    cell, _ = index.cells(x)
    codes, error = index.encode(x - index.centroids[cell])
    for c in range(len(index.centroids)):
        own = cell == c
        if own.any():
            exact = np.linalg.norm(x[:40, None] - x[None, own], axis=-1)
            assert (np.abs(index.distances(x[:40] - index.centroids[c], codes[own]) - exact) <= error[own] + 1e-9).all()
