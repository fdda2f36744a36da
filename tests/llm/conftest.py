import pytest
from pyspark.sql import functions as F

from rulewright.llm._memory import small_batches


@pytest.fixture(autouse=True)
def _small(spark):
    small_batches(spark)


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names could clash with an operator's own."""

    def make(rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
        return df.withColumn("n", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("bucket", F.lit(0)).withColumn("score", F.lit(0.0)).withColumn("component", F.lit(9))

    return make


EDGE = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "x" * 3000), (9005, "a b " * 2000), (9006, "same text of a repeated row here"), (9007, "same text of a repeated row here")]


@pytest.fixture
def edge():
    return list(EDGE)
