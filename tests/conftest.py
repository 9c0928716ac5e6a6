import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegate.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        8,
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": str(folder / "shared"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    yield session
    session.stop()
