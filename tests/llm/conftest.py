import pytest

DOCS = "doc_id LONG, text STRING, node STRING, label INT, bucket LONG, _id INT, n_words STRING, score STRING, lang STRING, source STRING, n_chars LONG"
LONG = " ".join(f"word{i % 977} goes{i % 331}" for i in range(30_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names."""
    def row(doc_id, text, lang="en"):
        return (doc_id, text, "x", 1, 2, 3, "w", None, lang, None, None)

    prose = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho. " * 3
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, LONG), row(6, LONG), row(7, prose), row(7, prose),
            row(None, prose + "end"), row(None, None), row(8, "%%% !!! ###"), row(9, "Ünï çödé 日本語 😀\nÜnï çödé 日本語 😀", None),
            row(10, "a" * 5000), row(11, "\n\n\n"), row(12, prose[:150])]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
