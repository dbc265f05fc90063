"""Which column plays which part. Pure functions over names and schemas: no job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and words the log format and its users rely on.
LOAD_TIME_NAMES = ("date", "fecha", "datetime", "timestamp", "time")
SOURCE_TIME_NAMES = ("date", "fecha", "timestamp", "time")
ANALYSIS_TIME_WORDS = ("date", "time", "fecha")
READY_FALLBACKS = ("Flag_Ready", "Ready")
CONTROL_WORDS = ("sp", "setpoint", "target", "opt_")
CONTROL_CATEGORY, PROCESS_CATEGORY = "Control", "Proceso"
ON_SUFFIX, READY_SUFFIX = "_ON", "_READY"
TIME = "datetime"


def col(name: str) -> Column:
    """Column by its exact name: names may hold dots and blanks."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Roles:
    """Columns the operators work on.

    ``row_id``, a whole number, breaks ties of equal times, so that runs, first and
    last values do not depend on task order. ``unit`` separates plants that share
    a table; without it the table is one plant.
    """

    time: str = TIME
    on: str | None = None
    ready: str | None = None
    row_id: str | None = None
    unit: str | None = None

    @property
    def order(self) -> list[str]:
        return [self.time] + ([self.row_id] if self.row_id else [])

    @property
    def keys(self) -> list[str]:
        return [self.unit] if self.unit else []


def load_time_column(columns: Sequence[str]) -> str:
    """Time column of a raw log."""
    for name in columns:
        if name.lower() in LOAD_TIME_NAMES:
            return name
    raise ValueError(f"no time column among {list(columns)}")


def analysis_time_column(columns: Sequence[str]) -> str | None:
    """Time column for the KPI analysis: ``datetime``, else any name that mentions a date."""
    if TIME in columns:
        return TIME
    return next((c for c in columns if any(w in c.lower() for w in ANALYSIS_TIME_WORDS)), None)


def _prefixes(columns: Iterable[str], suffix: str) -> list[str]:
    return [c[: -len(suffix)] for c in columns if c.endswith(suffix) and len(c) > len(suffix)]


def primary_flags(columns: Sequence[str], prefix: str | None = None) -> tuple[str | None, str | None]:
    """The optimiser's own flags ``<PREFIX>_ON`` and ``<PREFIX>_READY``.

    Without ``prefix`` it is the one prefix that has both, or else the only one
    that has either. Several candidates are an error, never a guess.
    """
    if prefix is None:
        on, ready = _prefixes(columns, ON_SUFFIX), _prefixes(columns, READY_SUFFIX)
        found = [p for p in on if p in ready] or list(dict.fromkeys(on + ready))
        if len(found) > 1:
            raise ValueError(f"several flag prefixes {found}: pass prefix=")
        if not found:
            return None, None
        prefix = found[0]
    names = (prefix + ON_SUFFIX, prefix + READY_SUFFIX)
    return tuple(n if n in columns else None for n in names)  # type: ignore[return-value]


def converted_flags(columns: Sequence[str], prefix: str | None = None) -> tuple[str, ...]:
    """Columns typed as flags: the pair of the given prefix, or of the only prefix that has both names.

    A name that merely ends like a flag may be an analog signal, so nothing is guessed from it.
    """
    if prefix is None:
        ready = _prefixes(columns, READY_SUFFIX)
        pairs = [p for p in _prefixes(columns, ON_SUFFIX) if p in ready]
        if len(pairs) != 1:
            return ()
        prefix = pairs[0]
    return tuple(n for n in primary_flags(columns, prefix) if n)


def ready_column(columns: Sequence[str], prefix: str | None = None) -> str | None:
    """Readiness flag; ``None`` means the ready filter keeps every row."""
    ready = primary_flags(columns, prefix)[1]
    return ready or next((c for c in READY_FALLBACKS if c in columns), None)


def on_column(columns: Sequence[str], prefix: str | None = None) -> str | None:
    """ON flag, else the first column whose name contains "on"."""
    on = primary_flags(columns, prefix)[0]
    return on or next((c for c in columns if "on" in c.lower()), None)


def resolve_roles(
    columns: Sequence[str], prefix: str | None = None, row_id: str | None = None, unit: str | None = None
) -> Roles:
    time = analysis_time_column(columns)
    if time is None:
        raise ValueError(f"no time column among {list(columns)}")
    return Roles(time, on_column(columns, prefix), ready_column(columns, prefix), row_id, unit)


def primary_roles(columns: Sequence[str], prefix: str | None = None, row_id: str | None = None) -> Roles:
    """Roles for the efficiency counts: only the optimiser's own flags, no stand-ins."""
    on, ready = primary_flags(columns, prefix)
    return Roles(TIME, on, ready, row_id)


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType)]


def kpi_candidates(schema: T.StructType, roles: Roles) -> list[str]:
    """Numeric columns that are neither state flags nor keys."""
    taken = {TIME, roles.time, roles.on, roles.ready, roles.row_id, roles.unit}
    return [c for c in numeric_columns(schema) if c not in taken]


def signal_category(name: str) -> str:
    lower = name.lower()
    return CONTROL_CATEGORY if any(w in lower for w in CONTROL_WORDS) else PROCESS_CATEGORY


def search_scope(
    columns: Sequence[str], scope: str = "all", numeric: Sequence[str] = (), explicit: Sequence[str] = ()
) -> list[str]:
    """Columns a text search looks at: ``all``, ``numeric`` (all if none chosen) or ``explicit``."""
    if scope == "explicit":
        return list(explicit)
    if scope == "numeric" and numeric:
        return list(numeric)
    if scope not in ("all", "numeric"):
        raise ValueError(f"unknown scope {scope!r}")
    return list(columns)


def unique_names(names: Iterable[str]) -> list[str]:
    """Make header names unique: a repeated name gets the lowest free suffix ``_1``, ``_2``, ..."""
    result: list[str] = []
    used: set[str] = set()
    for name in names:
        candidates = (name if i == 0 else f"{name}_{i}" for i in range(len(used) + 1))
        free = next(c for c in candidates if c not in used)
        used.add(free)
        result.append(free)
    return result


def parse_header(line: str) -> list[str]:
    """Column names of a header line."""
    return unique_names(part.strip() for part in line.split("\t"))


def rename_date_column(df: DataFrame) -> DataFrame:
    """A table without ``datetime`` but with ``Date`` uses the latter."""
    if TIME not in df.columns and "Date" in df.columns:
        return df.withColumnRenamed("Date", TIME)
    return df


def drop_duplicate_time(df: DataFrame) -> DataFrame:
    """Drop ``datetime`` when the source's own time column is still there."""
    if TIME in df.columns and any(c != TIME and c.lower() in SOURCE_TIME_NAMES for c in df.columns):
        return df.drop(TIME)
    return df
