import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (id, text) rows."""

    def make(rows, extra=()):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name in extra:  # columns that clash with those of the operators
            df = df.selectExpr("*", f"'mine' AS {name}")
        return df

    return make
