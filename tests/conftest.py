import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(at / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows_of(df):
    """Rows as a sorted list of tuples, columns by name, floats rounded."""
    cols = sorted(df.columns)
    tidy = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 2")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.sql(sql)
    cols = sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    tidy = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return cols, sorted((tuple(tidy(r[i]) for i in at) for r in found.fetchall()), key=repr)
