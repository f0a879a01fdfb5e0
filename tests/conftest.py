import pytest

from faultline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of one file, numbered from 1."""
    def make(*values, file="a.log"):
        rows = [(file, i, value) for i, value in enumerate(values, 1)]
        return spark.createDataFrame(rows, "file string, line_id bigint, value string")

    return make
