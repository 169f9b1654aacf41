import os
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from linespan.llm import bpe, langid, simhash
from linespan.llm.common import shared_dir
from linespan.llm.queries import ORACLE_SQL, QUERIES
from test_text_operators import dedup_plainly, mix_plainly, print_of, sha

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def shingled(text):
    """The set of five-word shingles by definition; the whole text if it is shorter."""
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def chain(spark, docs, to):
    """What each stage gives, written and read again in between."""
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], None).write.parquet(f"{to}/{k}")
        out.append(spark.read.parquet(f"{to}/{k}"))
    return out


def test_stages_against_plain_versions(spark, docs, tmp_path):
    raw, known, lines, near, mixed, encoded = chain(spark, docs, tmp_path)
    assert known.columns == lines.columns == near.columns == mixed.columns == raw.columns == NAMES
    # 1: only documents without a language go
    judged = {r.doc_id: r for r in langid.predict(raw, langid.fit(raw)).collect()}
    kept = {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in known.collect()} == kept and len(kept) > 0.95 * raw.count()
    # 2: texts lose the lines of others
    rows = [(r.doc_id, r.text) for r in known.collect()]
    want = {i: h for i, _, _, h in dedup_plainly(rows)}
    assert {r.doc_id: sha(r.text) for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    # 3: the first of each group stays
    rows = sorted((r.doc_id, print_of(r.text), shingled(r.text)) for r in lines.collect())
    near_by = lambda a, b: (a[1] ^ b[1]).bit_count() <= 3 or (len(a[2] & b[2]) / len(a[2] | b[2]) >= 0.8 if a[2] and b[2] else False)
    pairs = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[:k] if near_by(a, b)]
    group = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    assert {r.doc_id for r in near.collect()} == set(group.values()) and near.count() == len(set(group.values()))
    # 4: sources are read as often as their weights say
    rows = [(r.doc_id, r.text, r.source) for r in near.collect()]
    epochs, total = mix_plainly(rows)
    read = defaultdict(int)
    for r in mixed.collect():
        read[r.source] += len((r.text or "").split())
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert all(abs(read[s] - epochs[s] * total[s]) <= longest for s in total)
    assert {r.doc_id for r in mixed.collect()} == {i for i, _, _ in rows}
    # 5: ids are the library's
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(lib.encode_ordinary(r.text)), sha(r.text)) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in encoded.collect()) == want


def test_run_is_the_stages_one_after_the_other(spark, docs, tmp_path):
    encoded = chain(spark, docs, tmp_path)[-1]
    plain = lambda df: Counter((r.doc_id, r.source, r.lang, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in df.collect())
    scratch = shared_dir(spark)
    before = set(os.listdir(scratch))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert plain(out) == plain(encoded)
    left = set(os.listdir(scratch)) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["stage-mixing-sources"]


def test_repeated_ids_keep_their_different_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "b", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (1, "eins zwei drei vier fünf sechs sieben", "de", "a", 2), (2, "Alpha beta gamma delta epsilon zeta", "en", "a", 1), (None, "x", "en", "a", 1), (1, None, None, None, None)]
    out = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), None)
    assert Counter(tuple(r) for r in out.collect()) == Counter([rows[1], rows[2], rows[4], rows[5]])


def test_odd_rows_go_through(spark, odd, none, tmp_path):
    # stage 1 keeps all rows that have letters
    out = chain(spark, odd.select(*NAMES), tmp_path / "odd")
    ids = [{r.doc_id for r in x.collect()} for x in out]
    assert {6, 7, 8, 9} & ids[1] == set() and None in ids[1] and 10 in ids[1]
    assert ids[2] == ids[1] and ids[3] <= ids[2] and ids[4] == ids[3] == ids[5]
    assert 11 not in ids[3] and out[3].where("doc_id = 10").count() == 1
    assert all(x.count() == 0 for x in chain(spark, none.select(*NAMES), tmp_path / "none"))


def test_registered():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "byte-level BPE"]
    assert simhash.SHINGLE == 3 and F is not None
