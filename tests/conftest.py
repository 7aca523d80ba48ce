import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2",
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def lines(spark):
    def make(text, trace="t"):
        rows = text if isinstance(text, list) else text.split("\n")
        return spark.createDataFrame([(trace, i, v) for i, v in enumerate(rows)],
                                     "trace_id string, line_no bigint, value string")
    return make


@pytest.fixture
def trace(lines):
    from spanloom.operators.assemble import assemble
    from spanloom.sources.tokens import tokenize

    return lambda text: assemble(tokenize(lines(text)))
