import pytest

SF = "/root/testdata/sf0.001"

HARD = [
    None,
    "",
    " \n\t ",
    "a",
    "word " * 3000,
    "one two three four five",
    "one two three four five",
    "One Two Three Four Five",
    "été 中文 한국어 кот \U0001f600 ½ ßİ",
    "x" * 5000,
    "0123456789" * 30,
    "line one\nline two\nline one\n\n",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4 + "end",
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", "x", 1, None) for i, t in enumerate(HARD)]
    rows += [rows[6], (None, "no id here at all", None, None, None, "y"), (None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, digest string, salt int, `node` string, kept string, id string"
    rows = [(*r, None, "z") for r in rows]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
