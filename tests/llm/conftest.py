import pytest


@pytest.fixture(scope="session")
def vocab():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def corpus(folder):
    import pyarrow.parquet as pq

    return pq.read_table(f"{folder}/documents.parquet").to_pylist()
