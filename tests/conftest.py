import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import check

    # Blocks of a few rows, so that every job crosses block edges on small data.
    session = check.session(
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "cinetrace.blockRows": "7",
            "cinetrace.blockMs": "60000",
            "cinetrace.foldRows": "25",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import check

    return check.duck(DATA)
