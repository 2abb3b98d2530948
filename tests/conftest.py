import pytest

from codequarry.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", partitions=4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    yield s
    s.stop()
