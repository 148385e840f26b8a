import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketmood.session import build_session
    s = build_session("local[*]", 8)
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="mm-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


def series_df(spark, values, symbol="S", start_day=1):
    import datetime as dt
    rows = [(symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


def col_values(df, c, order="date"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]
