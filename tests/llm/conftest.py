import pytest

from tickframe.llm.common import ship

from .brute import DATA, ODD_COLUMNS, odd_rows


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    """Id and text of the smallest test table's documents."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
