import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Predictions of one model (or several) from (model, id, label, score) tuples."""

    def build(rows, split="test"):
        names = []
        for r in rows:
            if r[0] not in names:
                names.append(r[0])
        return spark.createDataFrame(
            [(m, names.index(m), split, i, y, s) for m, i, y, s in rows],
            "model_name string, model_order int, split string, id bigint, label int, y_score double",
        )

    return build
