"""Order-insensitive comparison of a Spark result with a SQL result."""

import math

import pandas as pd


def _value(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "~"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(_value(x) for x in r) for r in frame.itertuples(index=False, name=None))


def assert_same(spark_frame, sql_frame):
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
