import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a very long one, repeated rows, null and repeated keys,
    and a column whose name operators use for their results."""
    long = "alpha beta gamma delta " * 4000 + "x" * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)),
            (4, "Ça va? It's 'start' ''s <|endoftext|> ½ İΣ 日本", "fr", "s", 40), (4, "other text of the same id", "en", "s", 5),
            (5, "same row twice here ok", "en", None, 22), (5, "same row twice here ok", "en", None, 22),
            (None, "no key at all", "en", "s", 13), (6, " \n\t ", "en", "s", 4)]
    return frame(spark, [(*r, k) for k, r in enumerate(rows)],
                 DOCS + ", ids long").withColumnRenamed("ids", "n_tokens")


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
