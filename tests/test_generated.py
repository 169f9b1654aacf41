from linespan import queries

MARKERS = (b"license", b"copyright")


def test_every_file_by_bytes(spark, tmp_path):
    texts = ["é" * 496 + "License", "é" * 497 + "License", "a" * 993 + "LICENSE", "a" * 994 + "LICENSE", "é" * 499 + "aé", "漢" * 331 + "License", "漢" * 333 + "字 license", "ñ Copyright ñ", "", None, "no marker", "x" * 2000 + "é copyright"]
    rows = [(i, t, "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.location: r.generated for r in queries.QUERIES["generated_flag"](spark, str(tmp_path)).collect()}
    head = lambda t: (t or "").encode()[:1000].lower()
    assert got == {f"s/{i}": any(m in head(t) for m in MARKERS) for i, t in enumerate(texts)}
    assert sum(got.values()) == 4
