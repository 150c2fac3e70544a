"""Trailing frames over a customer's payments.

A row's history is what sorts before it by (time, id) and is at most W older, bounds included. Rows of equal time that
sort earlier are history too, so neither RANGE nor ROWS alone will do: the order key joins the time in microseconds with
the row's place among all of the customer's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.columns import micros

DAY = 86_400_000_000
#: More than the rows of any customer, so that a place never spills into the time; times of 10**17 microseconds fit in.
STEP = 10**12
ORDER = "_order_key"


def with_order_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """df with the order key of its rows within `key`."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn(ORDER, micros(F.col(ts)).cast("decimal(38,0)") * F.lit(STEP).cast("decimal(13,0)") + place)


def trailing(expression: str, key: str, width: int, inclusive: bool = False) -> Column:
    """An aggregate over the frame of the last `width` microseconds, without the current row unless inclusive."""
    end = "CURRENT ROW" if inclusive else "CAST(1 AS DECIMAL(38,0)) PRECEDING"
    return F.expr(f"{expression} OVER (PARTITION BY `{key}` ORDER BY {ORDER} RANGE BETWEEN CAST({width * STEP + STEP - 1} AS DECIMAL(38,0)) PRECEDING AND {end})")
