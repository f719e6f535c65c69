import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ["size", "k", "row", "digest", "fp", "n", "kept", "t", "hits", "target", "taken", "root", "score", "tie"]


def cases() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows and ids."""
    long = "Alpha beta gamma delta. " * 4000
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
        (2, "one two three  four five six seven\neight nine ten eleven", "en", "a", 5),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, long, "de", "b", 9),
        (6, " \n\t ", "fr", None, 4),
        (7, "password = 'abcdefghijkl+/12' and AKIAABCDEFGHIJ1234 0123456789abcdef", "en", "c", 3),
        (7, "password = 'abcdefghijkl+/12' and AKIAABCDEFGHIJ1234 0123456789abcdef", "en", "c", 3),
        (8, "token: token: short secret=aaaaaaaaaaaa Api_Key:\"zzzzzzzzzzzzzzzz\"", "en", "c", 3),
        (8, "another text under the same id, released under the MIT license", "en", "d", 3),
        (None, "one two three four five six seven eight nine ten eleven", "es", "a", 1),
        (None, "no id at all but some words café ÀÉ ſK 中文 👍 here", "es", "é", 1),
        (9, "Ünïcode 👍👍 text \u0085 with odd white space ſ", "xx", "zz", 1),
    ]
    return rows + [(100 + k, f"clean text number {k % 7} of the batch, all words are fine " + "x" * (k % 3), "en", "ab"[k % 2], k) for k in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    """The cases with extra columns of clashing names."""
    df = spark.createDataFrame(cases(), SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"n_chars AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The whole small table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
