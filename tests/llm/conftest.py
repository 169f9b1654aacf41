import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, ids string, score string, component_id string, kept_text string, row int, epoch int, block int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeats, empty and long texts, and extra columns named like results."""
    line = "A line that stands in many documents, long enough to be judged."
    long = "word " * 60_000
    texts = [
        (1, "alpha beta gamma delta epsilon zeta eta theta\n" + line, "en"), (2, line + "\nsecond own line of this document is here", "en"), (3, line.upper() + "  ", "de"), (4, "\t" + line + "\n\n" + line, None), (5, line, "fr"),
        (6, None, "en"), (7, "", None), (8, " \n\t ", "en"), (9, "12345 !!! ???", "en"), (10, long, "en"), (10, long, "en"), (11, long + "x", "es"), (None, "no id at all, but a text\n" + line, "en"), (None, None, None), (12, "one", "en"), (13, "漢字かな混じり文" * 50, "ja"), (14, "naïve café \U0001f600 ﬁn", "fr"), (-3, "negative", "en"),
    ]
    rows = [(i, t, g, None if k % 5 == 4 else f"s{k % 3}", None, 9, "x", "y", "z", "k", 1, 2, 3) for k, (i, t, g) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1), (5, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    """The driver's small documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
