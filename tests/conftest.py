import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs a query and its SQL on the smallest tables and compares the rows."""
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 5)
        if hasattr(v, "tolist"):
            v = v.tolist()
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)

    def compare(spark, query, sql):
        mine, theirs = query(spark, str(DATA)).toPandas(), con.sql(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)

    return compare
