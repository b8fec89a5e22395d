"""Paged, snapshot-consistent delivery of a table's rows in file order.

The number of rows of all files comes from one job over their footers; a file is opened only when the
window reaches it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import kind_of
from ..sources.delta import absolute, read_snapshot, snapshot
from ..sources.files import plain_path
from ..sources.tables import TableRef

DEFAULT_BATCH, MOST_BATCH = 10_000, 100_000


@dataclass
class Batch:
    start: int
    rows: list[dict[str, Any]]


@dataclass
class TableStream:
    """Columns, their kinds, the table's number of rows, and an iterator of batches."""

    columns: list[str]
    types: list[str]
    total_rows: int
    _files: list[tuple[str, int]] = field(repr=False, default_factory=list)  # each file and its number of rows
    _open: Callable[[str], DataFrame] = field(repr=False, default=None)  # the rows of a file
    batch_size: int = DEFAULT_BATCH
    offset: int = 0
    limit: int | None = None

    def __iter__(self) -> Iterator[Batch]:
        """Files outside of [offset, offset + limit) are not read; a file's rows come in their order."""
        end = self.total_rows if self.limit is None else min(self.total_rows, self.offset + self.limit)
        at, start, held = 0, self.offset, []
        for file, n in self._files:
            if at >= end:
                break
            first, last = max(self.offset, at), min(end, at + n)
            if first < last:
                window = _placed(self._open(file)).where((F.col("__at") >= first - at) & (F.col("__at") < last - at)).orderBy("__at").drop("__at")
                for row in window.toLocalIterator(prefetchPartitions=False):
                    held.append(row.asDict())
                    if len(held) == self.batch_size:
                        yield Batch(start, held)
                        start, held = start + len(held), []
            at += n
        if held:
            yield Batch(start, held)

    def ndjson(self) -> Iterator[str]:
        """A header line, then a line for each batch."""
        yield json.dumps({"columns": self.columns, "types": self.types, "totalRows": self.total_rows})
        for b in self:
            yield json.dumps({"start": b.start, "rows": b.rows}, default=str)


def open_stream(spark: SparkSession, ref: TableRef, batch_size: int = DEFAULT_BATCH, offset: int = 0, limit: int | None = None) -> TableStream:
    """Pins the table's files now; later writes do not show. batch_size is held between 1 and MOST_BATCH."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    if ref.kind == "delta":
        snap = snapshot(spark, ref.path)
        frame, files = read_snapshot(spark, snap), list(snap.files)
        place = {f: absolute(snap, f) for f in files}
        open_file = lambda f: read_snapshot(spark, replace(snap, files={f: snap.files[f]}))
    else:
        frame, files = ref.read(spark), ref.files()
        place = {f: f for f in files}
        open_file = lambda f: spark.read.schema(frame.schema).parquet(f)
    counts = {}
    if files:
        every = spark.read.schema(frame.schema).parquet(*place.values())
        counts = {plain_path(r.file): r.n for r in every.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()}  # a row for each file
    numbered = [(f, counts.get(plain_path(place[f]), 0)) for f in files]
    fields = frame.schema.fields
    return TableStream([f.name for f in fields], [kind_of(f.dataType) for f in fields], sum(n for _, n in numbered), numbered, open_file, max(1, min(MOST_BATCH, batch_size)), offset, limit)


def _placed(df: DataFrame) -> DataFrame:
    """With the place of each row in its file."""
    return df.select("*", F.expr("_metadata.row_index").alias("__at"))
