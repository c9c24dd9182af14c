import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cases_frame(spark):
    """Builds a case table from (run, truth, predicted, confidence[, score]) rows."""
    def make(rows):
        full = [(i, *(list(r) + [None] * (5 - len(r)))) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, "case_id long, run_id string, ground_truth string, predicted string, confidence double, score double")
    return make
