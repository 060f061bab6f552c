import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, kept string, m int, found string, r0 string, text_ string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with columns whose names operators use inside."""

    def make(texts, ids=None, lang="en", source="s"):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, lang, source, None, 1, "k", 2, "f", "r", "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
