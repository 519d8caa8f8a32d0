import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_corpus import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Null and repeated ids, repeated rows, and columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    more = rows[:6] + [(None, "a null id", "en", "a", 9), (None, "a null id", "en", "a", 9), (rows[0][0], "another text of that id", "en", "b", 20)]
    names = ["row", "words", "size", "group", "block", "unit", "line", "key", "n", "id", "q", "d", "h", "kept", "fp", "component", "start", "target", "shard"]
    return spark.createDataFrame(rows + more, SCHEMA).withColumns({x: F.lit(x) for x in names}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path
