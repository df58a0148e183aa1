import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from support import TESTDATA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tenderloom.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        shuffle_partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from tenderloom.plans.inputs import Inputs

    return Inputs(spark, TESTDATA)
