"""INSERT, UPDATE and DELETE on versioned tables: new files first, then the manifest.

Rows never pass through the driver, but for the literal rows of INSERT VALUES.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from ..sources.files import plain_path
from ..sources.tables import Column, TableRef, TableStore

#: Rows in each file of the matches of an UPDATE: a task that gathers them sorts a few files.
SLICE_ROWS = 250_000
#: Up to so many matches may be sent to all tasks, if Spark finds them small; their size on disk says little of that in memory.
FEW_MATCHES = 50_000


def stored_schema(columns: list[Column]) -> T.StructType:
    return T.StructType([T.StructField(c.name, T.DataType.fromDDL(c.spark)) for c in columns])


def numbered(rows: DataFrame, scratch: str) -> DataFrame:
    """rows with `__n`, 1 to their number, in partition order: one scan to count partitions, none through one task.

    rows are written to scratch first, because numbering needs them twice in the same order.
    """
    mark = F.monotonically_increasing_id()
    rows.withColumn("__mark", mark).write.parquet(scratch)
    held = rows.sparkSession.read.parquet(scratch)
    parts = held.groupBy(F.shiftright("__mark", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each partition
    before, total = {}, 0
    for r in parts:
        before[r.p], total = total, total + r.n
    start = F.element_at(F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n))]), F.shiftright("__mark", 33)) if before else F.lit(0)
    return held.withColumn("__n", start + F.col("__mark").bitwiseAND((1 << 33) - 1) + 1).drop("__mark")


def completed(rows: DataFrame, given: list[str], columns: list[Column], defaults: dict[str, str], computed: dict[str, str], identity_from: int | None, scratch: str) -> DataFrame:
    """Full rows of a table from the given columns (in order): casts, identity, defaults, then computed columns.

    defaults and computed are Spark SQL text; computed text names the table's columns.
    """
    rows = rows.toDF(*[f"__c{i}" for i in range(len(given))])
    place = {c.lower(): i for i, c in enumerate(given)}
    ident = next((c for c in columns if c.identity), None)
    if ident and ident.name.lower() not in place:
        rows = numbered(rows, scratch)
    out = []
    for c in columns:
        if c.computed:
            continue
        if c.name.lower() in place:
            value = F.col(f"__c{place[c.name.lower()]}").cast(c.spark)
        elif c.identity:
            seed, step = c.identity
            base = identity_from if identity_from is not None else seed - step
            value = (F.lit(base) + F.lit(step) * F.col("__n")).cast(c.spark)
        elif c.name in defaults:
            value = F.expr(defaults[c.name]).cast(c.spark)
        else:
            value = F.lit(None).cast(c.spark)
        out.append(value.alias(c.name))
    return with_computed(rows.select(*out), columns, computed)


def with_computed(rows: DataFrame, columns: list[Column], computed: dict[str, str]) -> DataFrame:
    return rows.select(*(F.expr(computed[c.name]).cast(c.spark).alias(c.name) if c.computed else F.col(f"`{c.name}`").cast(c.spark).alias(c.name) for c in columns))


def append(store: TableStore, ref: TableRef, rows: DataFrame) -> int:
    """Adds rows as new files; gives their number."""
    part = store.write_part(ref, rows)
    written = rows.sparkSession.read.schema(stored_schema(ref.manifest.columns)).parquet(str(ref.path.parent / part))
    n = written.count()  # from the files' footers
    identity = ref.manifest.identity
    ident = next((c for c in ref.manifest.columns if c.identity), None)
    if ident and n:
        ends = written.agg(F.max(f"`{ident.name}`").alias("hi"), F.min(f"`{ident.name}`").alias("lo")).first()
        last = ends.hi if ident.identity[1] > 0 else ends.lo
        if last is not None and (identity is None or (last > identity) == (ident.identity[1] > 0)):
            identity = last
    store.publish(ref, [*ref.manifest.parts, part] if n else ref.manifest.parts, identity)
    return n


def rows_of(spark: SparkSession, ref: TableRef, files: Iterable[str]) -> DataFrame:
    """The rows of some of the table's files, named as `_metadata.file_path` names them."""
    wanted = {plain_path(f) for f in files}
    return spark.read.schema(stored_schema(ref.manifest.columns)).parquet(*(f for f in ref.files() if plain_path(f) in wanted))


def file_marks(rows: DataFrame) -> tuple[Expr, dict]:
    """What tells a row's file from the others that rows are read from, and the files by it.

    A hash of the file's name, as paths in every row would fill the memory of sorts and joins; the path where two hashes are equal.
    """
    files = sorted(rows.inputFiles())
    marks = dict(rows.sparkSession.createDataFrame([(f, f.rsplit("/", 1)[-1]) for f in files], "file STRING, name STRING").select(F.xxhash64("name"), "file").collect())
    if len(marks) == len(files):
        return F.xxhash64("_metadata.file_name"), marks
    paths = rows.select(F.col("_metadata.file_path").alias("file")).distinct().collect()  # a row for each file
    return F.col("_metadata.file_path"), {r.file: r.file for r in paths}


def place(mark: Expr) -> Expr:
    return F.struct(mark.alias("file"), F.col("_metadata.row_index").alias("index"))


def last_matches(found: DataFrame, marks: list[dict]) -> DataFrame:
    """Of the matches of a row (`__file`, `__index`) the last one's `__new`, in the order of the joined tables' files and rows.

    `__at0`, `__at1` ... are places in the joined tables, and marks their files.
    """
    order = []
    for i, known in enumerate(marks):
        ranks = found.sparkSession.createDataFrame([(m, k) for k, m in enumerate(sorted(known, key=known.get))], [f"__mark{i}", f"__rank{i}"])
        found = found.join(F.broadcast(ranks), F.col(f"__at{i}.file") == F.col(f"__mark{i}"), "left")
        order += [F.when(F.col(f"__at{i}").isNotNull(), F.coalesce(f"__rank{i}", F.raise_error(F.lit("A file of a joined table is not known.")).cast("long"))), F.col(f"__at{i}.index")]
    order = [x.alias(f"o{i}") for i, x in enumerate(order)]
    return found.groupBy("__file", "__index").agg(F.max_by("__new", F.struct(*order, "__new")).alias("__new"))


def replace(store: TableStore, ref: TableRef, files: Iterable[str], rows: DataFrame) -> None:
    """Rows in place of those of some files, in one version. All other files stay."""
    gone, parts = {plain_path(f) for f in files}, []
    for part in ref.manifest.parts:
        own = ref.part_files(part)
        left = [f for f in own if plain_path(f) not in gone]
        folder = part if not part.endswith(".parquet") else part.rsplit("/", 1)[0]
        parts += [part] if len(left) == len(own) else [f"{folder}/{f.rsplit('/', 1)[-1]}" for f in left]
    store.publish(ref, [*parts, store.write_part(ref, rows)], ref.manifest.identity)


def cast_check(given: int, wanted: int) -> None:
    if given != wanted:
        raise SqlError(f"The number of values ({given}) does not match the number of columns ({wanted}).")


def literal_rows(spark: SparkSession, sql_rows: list[list[str]]) -> DataFrame:
    """Rows of literal expressions, in their order."""
    width = len(sql_rows[0])
    values = ", ".join("(" + ", ".join(r) + ")" for r in sql_rows)
    return spark.sql(f"SELECT {', '.join(f'c{i}' for i in range(width))} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(width))})").coalesce(1)
