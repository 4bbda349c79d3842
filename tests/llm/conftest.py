import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs, with a column named like an operator's own."""

    def make(pairs, source=None, bucket=True):
        rows = [(i, t, "en", source(k) if source else "s", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        out = spark.createDataFrame([Row(*r) for r in rows], DOCS)
        return out.withColumns({"bucket": out.doc_id, "class": out.text, "row": out.n_chars}) if bucket else out

    return make
