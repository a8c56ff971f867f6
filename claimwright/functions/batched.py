"""Python functions of one value as column functions, Arrow-batched, for what no expression can do."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def batched(f: Callable, kind: str) -> Callable[..., Column]:
    """*f* over columns. The UDF is made at the call, where a session exists, so modules import without one."""

    def of(*columns: Column | str) -> Column:
        def one(s: pd.Series) -> pd.Series:
            return s.map(f)

        def two(s: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series([f(a, b) for a, b in zip(s, t)], dtype=object)

        return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)

    return of
