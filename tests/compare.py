"""Row-for-row comparison of a Spark and a DuckDB result, whatever their order."""

import datetime
import decimal

import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (pd.Timestamp, datetime.date)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in pdf[columns].astype(object).itertuples(index=False))


def same(spark_df, duck, sql):
    assert rows(spark_df.toPandas()) == rows(duck.execute(sql).fetchdf())
