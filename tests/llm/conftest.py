import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCS, corpus


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumns({"kept": F.lit("clash"), "score": F.lit("clash"), "size": F.lit("clash")}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
