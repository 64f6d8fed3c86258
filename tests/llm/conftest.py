import pytest
from made_up import prose, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n long, score double, row string, f1 long, topic string, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty, blank, very long and repeated texts, equal ids, clashing names."""
    long_text = prose(1, 60000, 5000)
    same = prose(2, 120)
    rows = rows_of([None, "", " \n\t ", "one", "One", "two words", long_text, same, same, same, prose(3, 80)])
    rows += [(7, same, None, None, None, None, None, None, None, None)] * 3
    rows += [(None, same, "fr", "src1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += rows_of(["Ünï çödé " * 30, "| a | b | c |\n" * 20, "#$% ABC!! " * 40, "x" * 20000], 50, None, None)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(200)], "doc_id long, quality int, toxic int")
