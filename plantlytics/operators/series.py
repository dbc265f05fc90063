"""Signals over time in long form."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.functions import scalars as S
from plantlytics.operators.filters import ready_filter
from plantlytics.operators.stats import unpivot_numeric
from plantlytics.roles import Roles, col, quoted


def series_extract(
    df: DataFrame, roles: Roles, signals: Sequence[str], binary: Collection[str] = ()
) -> DataFrame:
    """Time, ``kpi`` and ``value`` of the chosen signals.

    Binary signals have no gaps: a missing value is 0 and all are clipped to 0..1
    (not truncated). The ON flag has a series of its own and is left out here.
    """
    names = [s for s in signals if s in df.columns and s != roles.on]
    ids = [col(c) for c in roles.order]

    def value(name: str):
        x = S.num(df, name)
        if name in binary:
            x = F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return x.alias(name)

    wide = df.select(*ids, *[value(n) for n in names])
    return wide.unpivot([quoted(c) for c in roles.order], [quoted(n) for n in names], "kpi", "value")


def series_split(df: DataFrame, roles: Roles, signals: Sequence[str]) -> DataFrame:
    """Ready rows in long form, tagged ``on`` 0 or 1."""
    ready = ready_filter(df, roles.ready)
    ids = [*[col(c) for c in roles.order], S.to01(ready, roles.on).alias("on")]
    return unpivot_numeric(ready, signals, ids)
