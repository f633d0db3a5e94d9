import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from fotoloom.session import local_session
    from fotoloom.ship import ship

    session = local_session(4, app="fotoloom-tests", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def small():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql():
    """A comparison of a query with its SQL in DuckDB, as sorted rows with columns by name."""
    import duckdb

    def compare(spark, name, query, sql, folder):
        db = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            db.execute(f"create view {p.stem} as select * from '{p}'")
        df = query(spark, folder)
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        got = sorted(tuple(plain(r[i]) for i in order) for r in df.collect())
        cur = db.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns), name
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall()), name

    return compare
