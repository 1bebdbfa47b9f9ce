import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with clashing extra columns."""

    def make(rows, extra=()):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long"
        )
        for name in extra:
            df = df.withColumn(name, F.lit("own"))
        return df

    return make
