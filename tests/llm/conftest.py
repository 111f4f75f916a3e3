import pytest

from riskframe.llm.tables import ready

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names the operators use inside."""
    ready(spark)

    def make(rows, extra=("kept", "n_words", "row_hash", "bucket", "id", "label", "t", "spans", "gone_id")):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *(None, "en", "s0")[len(row) - 1 :])
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        docs = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            docs = docs.withColumn(name, docs["lang"])
        return docs

    return make


@pytest.fixture(scope="session")
def sample_docs(spark, sf_dir):
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def sample_texts(sample_docs):
    return {r["doc_id"]: r["text"] for r in sample_docs.collect()}
