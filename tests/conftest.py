import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(rows, columns, relation) -> None:
    """Spark rows and a DuckDB relation hold the same rows, whatever their order."""
    assert sorted(columns) == sorted(relation.columns)
    order = sorted(columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str)
    places = [relation.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=str)
    assert ours == theirs


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con
