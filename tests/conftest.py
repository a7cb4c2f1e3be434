import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickframe import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tickframe-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Make a panel from ``{symbol: values}``, one row per day from 2024-01-01."""

    def make(values, start="2024-01-01", name="price"):
        rows = [(s, i, None if v is None else float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, f"symbol string, i int, {name} double")
        return df.selectExpr("symbol", f"date_add(date'{start}', i) as ts", name)

    return make


def column(df, *names, order="ts"):
    """Values of one or several columns in order of another."""
    rows = df.orderBy(order).select(*names).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]
