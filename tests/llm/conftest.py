import pytest
from pyspark.sql import types as T

ODD_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h bigint, bits bigint, item string, label int, number int, train string, id bigint, n_lines string"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empties, blanks, repeats, a null id, a very long text and ordinary ones."""
    prose = "The quick brown fox; it's 2 o'clock.\nUne fête à l'été, don't!"
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, prose), (4, prose), (None, "no id here"), (5, "word " * 30_000), (6, "x" * 5_000),
        (7, "日本語 テキスト 😀"), (8, "<|endoftext|> a <|ENDOFTEXT|>b"), (9, prose + "\n" + prose), (10, "A"), (11, "é    z"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows under columns whose names clash with the operators' own."""
    fill = (None, None, None, "k", 1, 2, "i", 0, 5, "t", 9, "n")
    return spark.createDataFrame([(*r, *fill) for r in odd_rows], ODD_COLUMNS).coalesce(2)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(ODD_COLUMNS))
