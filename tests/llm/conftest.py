import pytest


@pytest.fixture(scope="session")
def shared_folder(spark):
    """The session's folder for written stages."""
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def documents(spark, shared_folder):
    """Builder of a documents table from (doc_id, text[, lang, source]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")

    return build
