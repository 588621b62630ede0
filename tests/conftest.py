import pytest

from aeroledger.binding import ROW_KEY
from aeroledger.catalog import queries as catalog
from aeroledger.session import build_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    return catalog.star(spark, SMALL)


@pytest.fixture(scope="session")
def landing(spark):
    return catalog.landing(spark, SMALL)


@pytest.fixture(scope="session")
def curated(spark):
    return catalog.curated(spark, SMALL)


@pytest.fixture(scope="session")
def row_key():
    return ROW_KEY
