import pytest


@pytest.fixture
def table(spark):
    """A DataFrame of rows with extra columns whose names clash with inner ones."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for c in ("key", "label", "node", "size", "m", "start", "score", "n_words"):
            df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
