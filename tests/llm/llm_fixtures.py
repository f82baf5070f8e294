"""The fixture these tests share (imported by name, so that there is one conftest)."""
import pytest


@pytest.fixture
def make(spark):
    """DataFrames from rows and a schema string, dealt over several partitions."""
    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return build
