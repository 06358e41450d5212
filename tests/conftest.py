import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def make_bars(spark):
    """Bars from ``{symbol: [closes]}`` on consecutive days, or from full rows."""
    import datetime as dt

    from barloom.schema import BARS

    def make(series=None, rows=None, start=dt.date(2020, 1, 1), volume=100):
        if rows is None:
            rows = []
            for symbol, closes in series.items():
                for i, c in enumerate(closes):
                    day = start + dt.timedelta(days=i)
                    rows.append((symbol, day, float(c), float(c) + 1, float(c) - 1, float(c), volume + i))
        return spark.createDataFrame(rows, BARS)

    return make
