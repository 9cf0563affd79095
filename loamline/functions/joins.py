"""How tables that grow with the input meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` for joins that exchange both sides, so that it never passes whole through the driver.

    Spark guesses the size of rows made by parsing or from keys by that of the
    compressed files that they come from, often a hundredth of it, and would
    send such a table to every executor by way of the driver.
    """
    return df.hint("merge")
