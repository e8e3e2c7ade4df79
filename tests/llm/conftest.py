import pytest
from odd_documents import CLASH, SF, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    df = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string")
    df = df.selectExpr("*", "cast(length(text) as bigint) AS n_chars",
                       *[f"cast(null as {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in CLASH.split(", ")])
    from rollscope.llm.common import cut
    return cut(df.repartition(3), "odd")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.select("doc_id", "text", "lang", "source").collect()]
