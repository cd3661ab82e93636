"""Names of columns that operators only carry along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, made: list[str], gone: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """df under column names that no operator uses, those names by the old ones, and what gives a result its old names back.

    So a column of the input never clashes with a working column. Columns named as a made one are
    replaced; those of gone are left out.
    """
    names = {c: f"carried {i}" for i, c in enumerate(df.columns)}
    without = {c.lower() for c in (*made, *gone)}
    kept = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in without]
    return df.toDF(*names.values()), names, lambda out: out.select(*kept, *made)
