import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagequarry.session import builder

    folder = tmp_path_factory.mktemp("spark")
    session = (
        builder("local[8]", shuffle_partitions=8, input_partitions=8)
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """A pages table from html strings, or (url, html) pairs."""

    def make(*items):
        rows = [
            (i, *(x if isinstance(x, tuple) else (f"https://site.example.com/p/{i}", x)))
            for i, x in enumerate(items)
        ]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make
