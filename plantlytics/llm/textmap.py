"""Run an Arrow function over the texts of a table beside its other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import line, schema


def map_text(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], text: str = "text",
             keep: list[str] | None = None, plain_names: bool = False, **kinds: str) -> DataFrame:
    """The kept columns (all by default) and the columns ``kinds`` that ``make()`` computes from the texts.

    ``make`` runs once per task; its function gets the texts of a batch, NULL read as empty and each
    ended by a line feed, and returns an array per new column. Columns travel by place, so repeated names
    or names that differ by case only do no harm; with ``plain_names`` they stay ``c0, c1, ...`` in the result.
    """
    names = docs.columns
    places = [names.index(n) for n in keep] if keep is not None else list(range(len(names)))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source = F.col(f"c{names.index(text)}").cast("string") if text in names else F.lit("")
    fields = {f"c{i}": plain.schema[i].dataType.simpleString() for i in places} | kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(len(places))]
            arrays = columns + work(batch.column(len(places)))
            yield pa.RecordBatch.from_arrays(arrays, list(fields))

    out = plain.select(*[f"c{i}" for i in places], line(source).alias("_line")).mapInArrow(run, schema(**fields))
    return out if plain_names else out.toDF(*[names[i] for i in places], *kinds)
