import pytest

#: Documents with each odd case: null, empty, white space, repeated rows, repeated ids, a null id, a very long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two three four five"), (4, "one two three four five"), (None, "mail a.b@c.example.org or +1 (663) 555-6869"), (5, "é" * 30_000 + " 10.2.3.4"),
    (6, "x " * 40_000), (7, "Call +1 (663) 555-6869 now, or 4111 1111 1111 1111; again +1 (663) 555-6869."), (8, "You idiot. Fine day."),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "fp", 7, "th") for i, t in ODD], "doc_id long, text string, fp string, uid int, w string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
