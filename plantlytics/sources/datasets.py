"""Named datasets of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantlytics.roles import quoted, rename_date_column

MAIN, FILTERED = "df_principal", "df_filtrado"  # fixed values: names users know


class Datasets:
    """Register tables under a name and pick one per analysis.

    Temporary views: the data stays where it is. Register a written table, not a long
    plan, if several analyses use it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._names: list[str] = []

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(quoted(name))
        if name not in self._names:
            self._names.append(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        return rename_date_column(self.spark.table(quoted(name)))

    def available(self) -> list[str]:
        """Datasets with at least one row; the main and the filtered one come first."""
        first = [n for n in (MAIN, FILTERED) if n in self._names]
        rest = [n for n in self._names if n not in first]
        return [n for n in first + rest if not self.get(n).isEmpty()]
