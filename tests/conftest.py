import datetime as dt
import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
logging.getLogger("py4j").setLevel(logging.ERROR)


@pytest.fixture(scope="session")
def spark():
    from tidespine.session import local_session

    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def day(n: int, start: str = "2024-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=n)


def rows(df, *order):
    """Rows as tuples, sorted by the named columns (or all)."""
    cols = order or df.columns
    return sorted((tuple(r) for r in df.collect()), key=lambda r: repr([r[df.columns.index(c)] for c in cols]))


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
