"""Scalar rules of the domain as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
COST = "decimal(18,6)"
#: Default prices in USD for a million input, output and embedding tokens.
RATES = (5.0, 25.0, 0.02)
MODEL_UNKNOWN = "—"


def ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def month_start(t: datetime) -> datetime:
    return t.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def in_month(column: Column, as_of: datetime) -> Column:
    """From the month's start until as_of, what came later not being known yet."""
    return column.between(ntz(month_start(as_of)), ntz(as_of))


def since_days(column: Column, as_of: datetime, days: int) -> Column:
    return column.between(ntz(as_of - timedelta(days=days)), ntz(as_of))


def total(column: Column, kind: str, when: Column | None = None) -> Column:
    """A sum of a fixed type, 0 over nothing."""
    picked = column if when is None else F.when(when, column)
    return F.coalesce(F.sum(picked), F.lit(0)).cast(kind)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def token_cost(inputs: Column, outputs: Column, embedded: Column, rates: tuple[float, float, float] = RATES) -> Column:
    """USD, six decimals."""
    per = [F.lit(str(r)).cast("decimal(18,6)") for r in rates]
    micro = inputs.cast("decimal(20,0)") * per[0] + outputs.cast("decimal(20,0)") * per[1] + embedded.cast("decimal(20,0)") * per[2]
    return F.round(micro / F.lit(1_000_000), 6).cast("decimal(18,6)")


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def letters_and_digits(memo: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(memo, F.lit(""))), "[^A-Z0-9]", "")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def number_text(value: Column) -> Column:
    """A number with six significant digits at most, as C's %g; Spark's own formatting rounds halves another way."""

    @F.pandas_udf("string")
    def run(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: None if pd.isna(x) else f"{x:g}")

    return run(value.cast("double"))


def intent(text: Column, order_hints: tuple[str, ...], product_hints: tuple[str, ...]) -> Column:
    """order before product before knowledge, by substrings of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda hints: F.greatest(F.lit(False), F.lit(False), *(low.contains(h) for h in hints))
    return F.when(has(order_hints), "order").when(has(product_hints), "product").otherwise("knowledge")


def stale(event_s: Column, now_s: Column, window_s: int) -> Column:
    """Older than the window; an unknown or non-numeric time is never stale and a window of 0 switches it off."""
    if not window_s:
        return F.lit(False)
    t = event_s.try_cast("double")
    return F.coalesce((t != 0) & (now_s - t > window_s), F.lit(False))


def relevant(vscore: Column, kw: Column, kwscore: Column, least: float = 0.05, least_kw: float = 0.35) -> Column:
    return (vscore >= least) | (kw & (kwscore >= least_kw))
