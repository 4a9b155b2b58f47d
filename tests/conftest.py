import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from quern.session import build_session

    session = build_session("local[4]", 4, "tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of plain values, columns by name."""
    cols = sorted(frame.columns)

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        return str(v)

    data = frame[cols].astype(object)
    return cols, sorted((tuple(plain(v) for v in r) for r in data.where(frame[cols].notna(), None).values.tolist()), key=str)
