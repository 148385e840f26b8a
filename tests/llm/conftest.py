import pytest

SF001 = "/root/testdata/sf0.01"


def prose(i, n=60):
    """Distinct words, so that texts of different numbers share no shingle."""
    return " ".join(f"w{i}x{k}" for k in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank, very long and repeated texts, and columns whose names operators use inside."""
    rows = [(1, prose(1), "en"), (2, prose(1), "en"), (3, None, "de"), (4, "", None), (5, " \n\t ", "fr"),
            (6, prose(6, 60_000), "en"), (7, "One", "en"), (None, prose(8), "en"), (None, None, None),
            (9, prose(9), "en"), (9, prose(9), "en"), (9, prose(10), "es"), (10, "Äé ñ 日本 🙂 \x1f   x", "ja")]
    df = spark.createDataFrame([(i, t, s, "src", None if t is None else len(t)) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "row_key", "text_hash", "clean", "size", "shard", "h1", "bucket", "TEXT_HASH2"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF001}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF001}/benchmark.parquet")
