import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("block", T.LongType())])

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent elixirs for kings".split()


def odd_texts():
    """Nulls, empties, blanks, one word, ties, repeats, copies in another case, and a very long text."""
    long_text = "\n".join(" ".join(WORDS[(k + j) % len(WORDS)] + str(k % 97) for j in range(9)) for k in range(15_000))
    base = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 3))
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "two words"), (6, base), (7, base.upper()), (8, base), (8, base), (9, base + " tail"), (10, base.replace("fox3", "cat3")),
        (11, "ÉCOLE É école"), (12, "école é école"), (13, "a\n\nb\na"), (14, 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" 😀 password: hunter22'), (15, "AKIA" + "A1" * 9 + " api_key=short token: secret : abcdefgh12"),
        (16, "12345 678 !!"), (17, long_text), (18, "x" * 200_000), (19, "#" * 40 + " " + " ".join(WORDS)), (20, "same same same same same same same same same same same same"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 3 else "fr", None if i % 4 == 0 else f"s{i % 3}", None, "clash", 7) for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
