import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, near string, slot int, sequence_id int"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").cache()


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, odd characters."""
    texts = [
        None, "", " ", "\n\n \t", "a", "A b", "the same text here and there", "the same text here and there", "the same text here and there", "12 34 !?", "日本語 テキスト",
        "a <|endoftext|> b", "x\x01y \x01 z", "nul\0byte a\0b", "word " * 30000, "é" * 5000, "no blanks" * 900, "tab\tand  two blanks\r\nnew", "the same text here and there!", " 　x",
    ]
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "src", None, 1, "n", 2, 3) for k, t in enumerate(texts)]
    return rows + [rows[6], rows[0], (None, "the same text here and there", "en", "s", 1, 1, "n", 2, 3), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
