import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lumenfold.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", 4, "6g")
    yield spark
    spark.stop()
