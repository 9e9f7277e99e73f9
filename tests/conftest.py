import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{root}/warehouse").config("spark.checkpoint.dir", f"file://{root}/shared").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"file://{root}/shared")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def det(spark):
    """Detections from ``(start_s, [verdict], [station], [confidence])`` tuples."""

    def make(rows, recording="r1", species="a"):
        out = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (row,)
            start, verdict, station, conf = (*row, None, None, None)[:4]
            out.append((i, station or "s1", recording, species, float(start), float(start) + 2, conf if conf is not None else 0.5, verdict))
        return spark.createDataFrame(out, "det_id bigint, station string, recording string, species string, start_s double, end_s double, confidence double, verdict string")

    return make
