import pytest


@pytest.fixture
def files(spark, tmp_path):
    """Write rows as Parquet and read them back, since some operators name rows by file and place."""
    count = iter(range(1000))

    def make(rows, schema, parts=2):
        path = str(tmp_path / f"table{next(count)}")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
