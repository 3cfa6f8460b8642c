import pytest

from fleetlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "fleetlens-tests", "4g")
    # Small tables must still be cut into several pieces, or the seams between pieces go untested.
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield session
    session.stop()
