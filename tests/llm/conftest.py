import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The tests' own folder for checkpoints; a cluster names one in spark.checkpoint.dir."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
#: Rows with nulls, empty and very long texts, ties, repeated rows; the last columns clash with names that operators use.
EDGE = [
    (1, "", "en", "a", 0, 5, 1),
    (2, None, None, None, None, None, None),
    (3, " \n\t ", "en", "a", 4, 5, 1),
    (4, "one two three", "en", "a", 13, 5, 1),
    (5, "one two three", "en", "b", 13, 5, 1),
    (5, "one two three", "en", "b", 13, 5, 1),
    (None, "one two three four five six seven eight", "en", "b", 13, 5, 1),
    (6, "ONE two three four five six seven eight", "en", "b", 13, 5, 1),
    (7, LONG, "en", "b", len(LONG), 5, 1),
    (8, LONG + " tail", "en", "b", len(LONG), 5, 1),
    (9, "é ü 日本語 \u0000 x" * 30, "fr", "b", 9, 5, 1),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long"


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
