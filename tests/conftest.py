import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Checks a DataFrame against DuckDB SQL over the tables of a scale: columns by name, rows in any order."""
    import duckdb

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def run(df, sql, sf="sf0.001"):
        c = duckdb.connect()
        for t in Path(DATA, sf).glob("*.parquet"):
            c.execute(f"create view {t.stem} as select * from read_parquet('{t}')")
        cursor = c.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in cursor.fetchall()), key=repr)
        got = sorted((tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()), key=repr)
        assert got == want

    return run
