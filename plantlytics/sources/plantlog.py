"""Plant logs: tab-separated text with a ten-line preamble whose second line is the header.

Spark's text reader does the reading, so any file system works and large files are
split. Spark hands a task the lines of one split in order: a small Arrow function counts them,
drops the preamble, and numbers and cuts the rest, whole batches at a time.

A preamble may be longer than a split. Whether one is, a look at the first lines of the large files' splits tells;
for such files (none, usually) a table says which splits hold the first ten lines, and how many each.
"""

from __future__ import annotations

import csv
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantlytics.functions import scalars as S
from plantlytics.operators.ordering import row_numbers, written
from plantlytics.operators.prepare import prepare
from plantlytics.roles import col, load_time_column, parse_header

# Fixed values of the log format.
HEADER_INDEX = 1
PREAMBLE_LINES = 10
EXTENSIONS = ("txt", "tsv", "csv", "osf")
DISCOVER_EXTENSIONS = ("txt", "tsv", "csv")
DISCOVER_WORD = "STATISTICS"
DISCOVER_PREFIX = "2025-"
# Text the usual table readers take for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ROW_ID = "row_id"
HEADER_PLACE = -1  # instead of a place in the file: the row holds the file's header
REPLACEMENT = "\ufffd"
FEW_FILES = 1_000_000  # files whose first row ids, 16 bytes each, are broadcast
TASK_BYTES = 16 << 20  # smaller splits are read several to a task ...
TASKS_PER_CORE = 16  # ... as long as there are more tasks than this


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(col(c)).alias(c) for c in stacked.columns])


class HeaderMismatch(ValueError):
    """A file's header differs from the one the table is read with."""


def _paths(paths: Sequence[str] | str) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _text(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Lines with the split they come from; ``more`` if the file goes on behind it, ``replaced`` counts invalid bytes' replacements."""
    start, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    raw, valid = F.col("value"), F.make_valid_utf8("value")
    marks = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(REPLACEMENT), F.lit("")))
    return spark.read.text(_paths(paths)).select(
        valid.alias("line"),
        F.xxhash64("_metadata.file_path").alias("file_id"),
        start.alias("start"),
        (start + length < F.col("_metadata.file_size")).alias("more"),
        length.alias("length"),
        F.when(F.is_valid_utf8(raw), 0).otherwise((marks(valid) - marks(raw)) / len(REPLACEMENT.encode())).cast("int").alias("replaced"),
    )


def _packed(spark: SparkSession, paths: Sequence[str] | str, text: DataFrame) -> DataFrame:
    """Lines of :func:`_text`, with neighbouring splits in one task where they are so small that a task each would cost more than reading them."""
    if not _small_splits(spark):
        return text
    cost = _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    size = _listing(spark, paths).agg(F.sum(F.col("bytes") + cost)).first()[0] or 0
    return text.coalesce(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)))


def _small_splits(spark: SparkSession) -> bool:
    return _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) < TASK_BYTES


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of one batch that come from the same split: (file, start, from, to)."""
    files = batch.column(1).to_numpy(zero_copy_only=False)
    starts = batch.column(2).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(files)]):
        if b > a:
            yield int(files[a]), int(starts[a]), int(a), int(b)


def _cut(lines: pa.Array) -> pa.Array:
    """Fields per line. Only lines with quotes are read one by one."""
    quoted = pc.match_substring(lines, '"')
    if not pc.any(quoted).as_py():
        return pc.split_pattern(lines, "\t")
    plain = pc.split_pattern(lines.filter(pc.invert(quoted)), "\t")
    odd = pa.array([next(csv.reader([x], delimiter="\t")) for x in lines.filter(quoted).to_pylist()], pa.list_(pa.string()))
    there = quoted.to_numpy(zero_copy_only=False)
    place = np.where(there, len(plain) + np.cumsum(there) - 1, np.cumsum(~there) - 1)
    return pa.concat_arrays([plain.cast(pa.list_(pa.string())), odd]).take(pa.array(place))


def _field(cells: pa.Array, number: int) -> pa.Array:
    """One field of every line, NULL where a line is shorter."""
    starts = cells.offsets.to_numpy()
    places = starts[:-1] + number
    return cells.values.take(pa.array(places, mask=places >= starts[1:]))


def _body(expected: list[str] | None, fields: list[int] | None, strict: bool):
    """Arrow function that keeps data lines; a differing header fails at the first data line.

    ``fields`` are cut out as columns; without them whole lines are handed on as lists, and the header as a line of its own. ``early`` is the
    number of a line among the first ten of a split that is not its file's first: it may still belong to the preamble.
    ``strict``: no preamble reaches into a second split, and one that does is an error.
    """

    def cells_of(lines: pa.Array) -> list[pa.Array]:
        cells = _cut(lines)
        return [cells] if fields is None else [*[_field(cells, i) for i in fields], pc.list_value_length(cells)]

    names = [*(["cells"] if fields is None else [*[f"c{i}" for i in fields], "fields"]), "replaced", "file_id", "start", "place", "early"]

    def rows(cut: list[pa.Array], replaced: pa.Array, file: int, start: int, places: np.ndarray, early: np.ndarray) -> pa.RecordBatch:
        n = len(places)
        same = [pa.array(np.full(n, x, dtype=np.int64)) for x in (file, start)]
        return pa.RecordBatch.from_arrays([*cut, replaced, *same, pa.array(places), pa.array(early, pa.int32(), mask=early < 0)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, header, more = None, 0, None, False

        def close() -> None:
            if strict and split is not None and split[1] == 0 and more and seen < PREAMBLE_LINES:
                raise ValueError("a preamble reaches into a second split: the splits are smaller than when the table was planned")

        for batch in batches:
            lines = batch.column(0)
            for file, start, a, b in _segments(batch):
                if (file, start) != split:
                    close()
                    split, seen, header, more = (file, start), 0, None, batch.column(3)[a].as_py()
                first = a
                if start == 0:
                    if seen <= HEADER_INDEX < seen + b - a:
                        header = lines[a + HEADER_INDEX - seen].as_py()
                        if fields is None:
                            yield rows([pa.array([[header]], pa.list_(pa.string()))], pa.array([0], pa.int32()), file, start, np.array([HEADER_PLACE]), np.array([-1]))
                    first = min(b, a + max(0, PREAMBLE_LINES - seen))
                number = seen + np.arange(first - a, b - a, dtype=np.int64)
                seen += b - a
                if first == b:
                    continue
                body = lines.slice(first, b - first).cast(pa.string())
                filled = pc.not_equal(body, "")
                body, number = body.filter(filled), number[filled.to_numpy(zero_copy_only=False)]
                if not len(body):
                    continue
                if header is not None and expected is not None and parse_header(header) != expected:
                    raise HeaderMismatch(f"header {parse_header(header)} differs from {expected}")
                header = None
                # A split's lines begin behind its first byte, so places of two splits never meet.
                places = number if start == 0 else number + start + 1
                early = np.where((start > 0) & (number < PREAMBLE_LINES), number, -1)
                yield rows(cells_of(body), batch.column(5).slice(first, b - first).filter(filled), file, start, places, early)
        close()

    return run


def _first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first split that a task reads: its length, and how many of its first lines there are, up to ten. Reads no further."""
    found, seen, length = None, 0, 0
    for batch in batches:
        for file, start, a, b in _segments(batch):
            if found is None:
                found, length = (file, start), batch.column(4)[a].as_py()
            if found == (file, start):
                seen += b - a
        if seen >= PREAMBLE_LINES or found is not None and found != (file, start):
            break
    if found is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([found[0]]), pa.array([found[1]]), pa.array([length], pa.int64()), pa.array([min(seen, PREAMBLE_LINES)])],
            ["file_id", "start", "length", "lines"])


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First ten lines of each split."""
    split, seen = None, 0
    for batch in batches:
        for file, start, a, b in _segments(batch):
            if (file, start) != split:
                split, seen = (file, start), 0
            n = min(b - a, max(0, PREAMBLE_LINES - seen))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n), pa.array([start] * n), pa.array(range(seen, seen + n), pa.int64()), batch.column(0).slice(a, n)],
                    ["file_id", "start", "number", "line"])
            seen += b - a


def _preambles(expected: list[str] | None):
    """First ten lines of a file to the splits they lie in, with the lines before each, the header, and whether that differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for file, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before: dict[int, int] = {}
                for i, line in enumerate(lines):
                    before.setdefault(line["start"], i)
                header = lines[HEADER_INDEX]["line"] if len(lines) > HEADER_INDEX else None
                differs = header is not None and expected is not None and parse_header(header) != expected
                for column, value in zip(out, (file, [*before], [*before.values()], header, differs)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.bool_()))],
                ["file_id", "splits", "before", "header", "differs"])

    return run


def _long_preambles(spark: SparkSession, paths: Sequence[str] | str, expected: list[str] | None) -> DataFrame | None:
    """``file_id, splits, before, header, differs`` of the files whose preamble is longer than their first split; ``None`` if there is none.

    Files that fit in the smallest split Spark makes are not looked at. Of the others each task reads the first lines of its
    first split; a whole split fills a task, so the first split of every file that is split at all is among them. What can't be
    told this way is read once more, up to ten lines per split. Where several splits share a task, that is done at once.
    """
    smallest = min(_bytes(spark.conf.get(f"spark.sql.files.{x}")) for x in ("maxPartitionBytes", "openCostInBytes"))
    files = _listing(spark, paths).select(F.xxhash64("file").alias("file_id"), "bytes").where(F.col("bytes") > smallest)
    if files.isEmpty():
        return None
    if _small_splits(spark):
        open_files = files.select("file_id")
    else:
        seen = written(_text(spark, paths).mapInArrow(_first_of_partition, "file_id long, start long, length long, lines long"), "log-heads")
        largest = seen.agg(F.max("length")).first()[0] or 0  # the files are cut into splits of this length
        fine = seen.where((F.col("start") == 0) & (F.col("lines") == PREAMBLE_LINES)).select("file_id")
        open_files = written(files.where(F.col("bytes") > largest).join(fine, "file_id", "left_anti").select("file_id"), "log-long")
        if open_files.isEmpty():
            return None
    lines = _packed(spark, paths, _text(spark, paths)).mapInArrow(_first_lines, "file_id long, start long, number long, line string")
    lines = lines.join(open_files, "file_id", "left_semi")
    order = Window.partitionBy("file_id").orderBy("start", "number")
    tops = lines.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PREAMBLE_LINES)
    tops = tops.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("k", "start", "line"))).alias("lines"))
    tops = tops.where(F.coalesce(F.get("lines", F.lit(PREAMBLE_LINES - 1))["start"] > 0, F.lit(True)))
    kinds = "file_id long, splits array<long>, before array<long>, header string, differs boolean"
    late = written(tops.mapInArrow(_preambles(expected), kinds), "log-preambles")
    return None if late.isEmpty() else late


def _places(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``file_id, base``: the ids of a file's rows begin behind those of all files with smaller paths, one for each of their bytes."""
    files = _listing(spark, paths).select("file", (F.col("bytes") + 1).alias("room"))
    if files.count() <= FEW_FILES:
        before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # FEW_FILES rows at most
        bases = files.withColumn("base", F.coalesce(F.sum("room").over(before), F.lit(0)))
        return F.broadcast(bases.select(F.xxhash64("file").alias("file_id"), "base"))
    return row_numbers(files, ["file"], "base", FEW_FILES, "room").select(F.xxhash64("file").alias("file_id"), "base")


def _kept(cut: DataFrame, late: DataFrame | None) -> DataFrame:
    """Lines that are no preamble. ``late`` must tell of every split that holds a part of one."""
    if late is None:
        return cut.drop("start", "early")
    wide = cut.join(late.drop("header"), "file_id", "left")
    place = F.array_position("splits", F.col("start"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    data = (
        F.when(F.col("early").isNull() | F.col("splits").isNull() | (F.col("start") > F.array_max("splits")), True)
        .when(place == 0, fail("a preamble reaches into other splits than when the table was planned"))
        .otherwise(F.col("early") + F.get("before", (place - 1).cast("int")) >= PREAMBLE_LINES)
    )
    wide = wide.where(F.when(data, F.when(F.col("differs"), fail("a header differs from the first file's")).otherwise(True)).otherwise(False))
    return wide.select(*[c for c in cut.columns if c not in ("start", "early")])


def _cut_kinds(fields: Sequence[int] | None) -> str:
    cells = "cells array<string>" if fields is None else "".join(f"c{i} string, " for i in fields) + "fields int"
    return f"{cells}, replaced int, file_id long, start long, place long, early int"


def data_lines(
    spark: SparkSession,
    paths: Sequence[str] | str,
    header: Sequence[str] | None = None,
    fields: Sequence[int] = (),
    row_ids: bool = True,
) -> DataFrame:
    """``(c<i> ..., fields, replaced, file_id, place)`` of all non-blank lines after the preamble, with a ``row_id`` if wanted.

    ``c<i>`` is the text of a wanted field, ``fields`` how many the line has, ``replaced`` how many invalid bytes became
    replacement characters. ``row_id`` is unique over all files, however many and large, and follows their paths and the
    place in the file. With ``header`` every file that has data must carry exactly these names.
    """
    expected = None if header is None else list(header)
    late = _long_preambles(spark, paths, expected)
    cut = _packed(spark, paths, _text(spark, paths)).mapInArrow(_body(expected, list(fields), late is None), _cut_kinds(list(fields)))
    kept = _kept(cut, late)
    if not row_ids:
        return kept
    return kept.join(_places(spark, paths), "file_id").withColumn(ROW_ID, F.col("base") + F.col("place")).drop("base")


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file: the first lines only, nothing else is read."""
    top = spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).head(HEADER_INDEX + 1)
    if len(top) <= HEADER_INDEX:
        raise ValueError(f"{path} has no header line")
    return parse_header(top[HEADER_INDEX].value)


def _bytes(text: str) -> int:
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    number = text.lower().rstrip("b")
    return int(number[:-1]) << units[number[-1]] if number[-1] in units else int(number)


def read_plant_log(
    spark: SparkSession,
    paths: Sequence[str] | str,
    header: Sequence[str] | None = None,
    allow_missing: bool = False,
    columns: Sequence[str] | None = None,
    blank_missing: bool = True,
) -> DataFrame:
    """All files stacked as a table of text columns, in source order, plus ``row_id``.

    The header comes from the first file and every other file must agree, or the job
    fails. ``allow_missing`` instead takes the files as they are and fills columns a file lacks with NULL: their lines are cut
    once into a table in the shared folder, and its columns are told by the different headers found. Files without data give nothing,
    short lines are padded with NULL and surplus fields dropped. ``columns`` keeps only
    some columns. Text for a missing value becomes NULL, unless ``blank_missing`` is off
    because the typing that follows does it anyway.
    """
    if allow_missing:
        lines, layouts = _cut_once(spark, paths)
        lines = lines.join(_places(spark, paths), "file_id").withColumn(ROW_ID, F.col("base") + F.col("place"))
        names = [n for n in dict.fromkeys(n for layout in layouts for n in layout) if columns is None or n in columns]
        cells = {n: F.get("cells", _field_number(layouts, n)) for n in names}
    else:
        if header is None:
            header = read_header(spark, _first_file(spark, paths))
        wanted = [i for i, name in enumerate(header) if columns is None or name in columns]
        lines, cells = data_lines(spark, paths, header, wanted), {header[i]: F.col(f"c{i}") for i in wanted}

    def cell(name: str) -> Column:
        x = cells[name]
        return (F.when(~x.isin(*MISSING_TEXT), x) if blank_missing else x).alias(name)

    return lines.select(*[cell(n) for n in cells], ROW_ID)


def _cut_once(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """All lines ``cells, replaced, place, file_id, layout`` of files with different headers, and the layouts: read once, and written.

    The driver gets each different header once.
    """
    late = _long_preambles(spark, paths, None)
    cut = _packed(spark, paths, _text(spark, paths)).mapInArrow(_body(None, None, late is None), _cut_kinds(None))
    table = written(_kept(cut, late), "log-lines")
    data = table.where(F.col("place") != HEADER_PLACE)
    headers = table.where(F.col("place") == HEADER_PLACE).select("file_id", F.get("cells", F.lit(0)).alias("header"))
    if late is not None:
        own = late.where("header IS NOT NULL").select("file_id", "header")
        headers = headers.join(own, "file_id", "left_anti").union(own)
    headers = written(headers.join(data.select("file_id").distinct(), "file_id", "left_semi"), "log-headers")
    by_names: dict[tuple[str, ...], list[str]] = {}
    for row in headers.select("header").distinct().collect():
        by_names.setdefault(tuple(parse_header(row.header)), []).append(row.header)
    layouts = sorted(by_names)
    if not layouts:
        raise ValueError("no file has data")
    number = F.coalesce(*[F.when(F.col("header").isin(by_names[names]), i) for i, names in enumerate(layouts)])
    files = headers.select("file_id", number.alias("layout"))
    return data.join(F.broadcast(files) if files.count() <= FEW_FILES else files, "file_id"), layouts


def _field_number(layouts: list[tuple[str, ...]], name: str) -> Column:
    """Number of the field that holds a column, by the line's layout; NULL where a layout lacks it."""
    numbers = [F.lit(names.index(name) if name in names else None).cast("int") for names in layouts]
    return F.get(F.array(*numbers), F.col("layout"))


def surplus_fields(spark: SparkSession, paths: Sequence[str] | str, header: Sequence[str]) -> DataFrame:
    """How many data lines have more fields than the header: those fields are not read."""
    longer = F.col("fields") > len(header)
    return data_lines(spark, paths, header, row_ids=False).agg(F.count_if(longer).alias("lines_with_surplus"))


def _listing(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """One row per offered file; the contents are not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )


def _first_file(spark: SparkSession, paths: Sequence[str] | str) -> str:
    first = _listing(spark, paths).agg(F.min("file").alias("file")).first()
    if first is None or first.file is None:
        raise ValueError(f"no file below {paths}")
    return first.file


def load_logs(
    spark: SparkSession, paths: Sequence[str] | str, prefix: str | None = None, allow_missing: bool = False
) -> DataFrame:
    """Files to typed telemetry in one go."""
    raw = read_plant_log(spark, paths, allow_missing=allow_missing, blank_missing=False)
    return prepare(raw, prefix, keep=(ROW_ID,))


def load_summary(
    spark: SparkSession, paths: Sequence[str] | str, records: DataFrame | None = None, allow_missing: bool = False
) -> DataFrame:
    """One row: offered files, megabytes of the files with data, typed records, and invalid bytes replaced in data lines.

    The lines are read once: ``records`` are those with a readable time, unless a loaded table is given to count.
    """
    if allow_missing:
        lines, layouts = _cut_once(spark, paths)
        time = F.coalesce(*[F.when(F.col("layout") == i, F.get("cells", F.lit(x.index(load_time_column(x))))) for i, x in enumerate(layouts)])
    else:
        header = read_header(spark, _first_file(spark, paths)) if records is None else None
        at = [] if header is None else [header.index(load_time_column(header))]
        lines = data_lines(spark, paths, header, at, row_ids=False)
        time = F.col(f"c{at[0]}") if at else F.lit(None).cast("string")
    kept = lines.groupBy("file_id").agg(F.sum("replaced").alias("replaced"), F.count_if(S.parse_log_time(time).isNotNull()).alias("records"))
    files = _listing(spark, paths).withColumn("file_id", F.xxhash64("file"))
    sums = files.join(kept, "file_id", "left").agg(
        F.count(F.lit(1)).alias("file_count"),
        (F.coalesce(F.sum(F.when(F.col("records").isNotNull(), F.col("bytes"))), F.lit(0)) / (1 << 20)).alias("total_mb"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("replaced"), F.lit(0)).alias("replaced"),
    )
    if records is None:
        return sums
    return side_by_side(sums.drop("records"), records.agg(F.count(F.lit(1)).alias("records")))


def discover(
    spark: SparkSession, folder: str, prefix: str = DISCOVER_PREFIX, word: str = DISCOVER_WORD
) -> list[str]:
    """Sorted paths of the statistics logs directly in a folder."""
    extensions = ",".join(DISCOVER_EXTENSIONS)
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"{prefix}*.{{{extensions}}}")
        .load(folder)
        .select("_metadata.file_path", "_metadata.file_name")
    )
    rows = listing.where(F.col("file_name").contains(word)).collect()
    return sorted(r.file_path for r in rows)


def uploads(folder: str) -> str:
    """Glob of every file type the loader accepts; all of them hold the same format."""
    return f"{folder.rstrip('/')}/*.{{{','.join(EXTENSIONS)}}}"
