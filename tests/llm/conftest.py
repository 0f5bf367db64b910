import numpy as np
import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, token string, rep long"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents, with extra columns whose names the operators use inside."""

    def build(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, t, columns.get("lang", ["en"] * len(ids))[k], columns.get("source", [f"s{k % 3}"] * len(ids))[k], None if t is None else len(t), 7, "x", None)
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))
        ]
        return spark.createDataFrame(rows, DOC).repartition(3) if rows else spark.createDataFrame([], DOC)

    return build


@pytest.fixture(scope="session")
def words():
    """Texts of n words from a vocabulary large enough that only copies share five words in a row."""

    def make(n, seed):
        rng = np.random.default_rng(seed)
        return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))

    return make


@pytest.fixture(scope="session")
def table(spark):
    def read(name, sf="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")

    return read
