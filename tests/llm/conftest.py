import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text) pairs, with columns named like results of the operators."""

    def build(rows):
        extra = "doc_id long, text string, raw string, row int, n int, component_id int, score string, _h int, _p int, spans int"
        return spark.createDataFrame([(i, t, "r", 1, 2, 3, "s", 4, 5, 6) for i, t in rows], extra)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty and blank texts, a very long one, repeated rows, a null id."""
    base = " ".join(f"word{i} the of" for i in range(60))
    return make([
        (1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, "x" * 300_000), (7, "a b " * 40_000),
        (None, base + " tail"), (8, "tiny"), (9, "naïve café № 5 <|endoftext|> \U0001f600"), (10, "a\x1cb\x00c")])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
