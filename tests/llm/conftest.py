import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank long, part int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, odd blanks, columns with clashing names."""
    texts = [
        None, "", " \n ", "one", "the same text of more than five words", "the same text of more than five words",
        "tab\tand\xa0hard space \x1c and\r\nlines  \n\n end ", "<|endoftext|> don't  stop; <|endoftext|>x",
        "Ünïcödé ñandú ÇA 12.5 日本語 テキスト ́combining", "long " * 30_000, "x" * 50_000, None,
    ]
    rows = [(i, t, "en" if i % 2 else None, None, i, 0.5, i, 1) for i, t in enumerate(texts)]
    rows += [(4, texts[4], None, None, None, None, None, None), (None, "no id here", None, None, 3, 1.0, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(sf_dir):
    """(doc_id, text) of the smallest documents table."""
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
