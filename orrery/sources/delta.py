"""Read-only snapshots of Delta tables, by replay of the log.

The driver holds what a snapshot is, its list of files; of a checkpoint only the columns that are needed
come to it. The data files are one scan where their folders say their partition values, so that a filter
on these prunes folders; files elsewhere are a scan for each set of values.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from .files import SharedPath

# Reader features that a snapshot reader can ignore.
READER_FEATURES = {"timestampNtz", "appendOnly", "invariants"}


@dataclass
class Snapshot:
    path: SharedPath
    version: int = -1
    files: dict[str, dict] = field(default_factory=dict)  # path in the log -> partition values
    schema: T.StructType | None = None
    partitions: list[str] = field(default_factory=list)
    configuration: dict[str, str] = field(default_factory=dict)


def is_delta(path: SharedPath) -> bool:
    return (path / "_delta_log").is_dir()


def _check_protocol(p: dict) -> None:
    version = p.get("minReaderVersion") or 1
    if version <= 2:
        return
    unknown = sorted(set(p.get("readerFeatures") or ["unnamed"]) - READER_FEATURES)
    if unknown:
        raise SqlError(f"The Delta table needs reader features that are not supported: {', '.join(unknown)}.")


def snapshot(spark: SparkSession, path: SharedPath, as_of: int | None = None) -> Snapshot:
    """The state of the table after its last commit, or after commit as_of."""
    log = path / "_delta_log"
    commits = {int(p.stem): p for p in log.glob("*.json") if re.fullmatch(r"\d{20}", p.stem)}
    checkpoints: dict[int, list[SharedPath]] = {}
    for p in log.glob("*.checkpoint*.parquet"):
        m = re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet", p.name)
        if m:
            checkpoints.setdefault(int(m[1]), []).append(p)
            if m[3] and len(checkpoints[int(m[1])]) > int(m[3]):
                raise SqlError("The Delta log has too many parts of a checkpoint.")
    last = as_of if as_of is not None else max([*commits, *checkpoints], default=-1)
    if last < 0 or (as_of is not None and as_of not in commits and as_of not in checkpoints):
        raise SqlError(f"The Delta table has no version {as_of if as_of is not None else 0}.")
    out = Snapshot(path, last)
    base = max((v for v in checkpoints if v <= last), default=None)
    if base is not None:
        rows = spark.read.parquet(*map(str, sorted(checkpoints[base])))
        for kind in ("protocol", "metaData"):
            if kind in rows.columns:
                for row in rows.where(F.col(kind).isNotNull()).select(F.to_json(kind).alias("a")).collect():  # one or two rows
                    _apply(out, {kind: json.loads(row.a)})
        if "add" in rows.columns:
            values = F.col("add.partitionValues") if "partitionValues" in rows.schema["add"].dataType.names else F.lit(None)
            for row in rows.where("add is not null").select("add.path", values.alias("own")).collect():  # a checkpoint has each file that is there once
                _apply(out, {"add": {"path": row.path, "partitionValues": dict(row.own) if row.own is not None else None}})
    for v in range(base + 1 if base is not None else 0, last + 1):
        if v not in commits:
            raise SqlError(f"The Delta log lacks commit {v}.")
        for line in commits[v].read_text().splitlines():
            if line.strip():
                _apply(out, json.loads(line))
    if out.configuration.get("delta.columnMapping.mode", "none") != "none":
        raise SqlError("The Delta table uses column mapping, which is not supported.")
    return out


def _apply(out: Snapshot, action: dict) -> None:
    if a := action.get("add"):
        values = a.get("partitionValues")
        out.files[a["path"]] = dict(values) if isinstance(values, dict) else _hive_values(a["path"])
    elif r := action.get("remove"):
        out.files.pop(r["path"], None)
    if p := action.get("protocol"):
        _check_protocol(p)
    if m := action.get("metaData"):
        if m.get("schemaString"):
            out.schema = T.StructType.fromJson(json.loads(m["schemaString"]))
        out.partitions = list(m.get("partitionColumns") or [])
        out.configuration = dict(m.get("configuration") or {})


def _hive_values(path: str) -> dict:
    pairs = (part.split("=", 1) for part in path.split("/")[:-1] if "=" in part)
    return {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in pairs}


def absolute(snap: Snapshot, f: str) -> str:
    """Where a file of the log stands."""
    return unquote(f) if re.match(r"[a-z][a-z0-9+.-]*:", f) or f.startswith("/") else str(snap.path / unquote(f))


def read_snapshot(spark: SparkSession, snap: Snapshot) -> DataFrame:
    """The rows, with partition columns of their declared types, in the order of the table's schema."""
    if snap.schema is None:
        if not snap.files:
            raise SqlError("The Delta table has neither a schema nor files.")
        return spark.read.parquet(*(absolute(snap, f) for f in snap.files))
    foldered: list[str] = []
    groups: dict[tuple, list[str]] = {}
    for f, values in snap.files.items():
        own = {c: values.get(c) for c in snap.partitions}
        if own and not re.match(r"[a-z][a-z0-9+.-]*:|/", f) and list(_hive_values(f).items()) == list(own.items()):
            foldered.append(absolute(snap, f))
        else:
            groups.setdefault(tuple(own.items()), []).append(absolute(snap, f))
    names = [F.col(f"`{f.name}`") for f in snap.schema.fields]
    parts = [spark.read.schema(snap.schema).option("basePath", str(snap.path)).parquet(*foldered).select(*names)] if foldered else []
    stored = T.StructType([f for f in snap.schema.fields if f.name not in snap.partitions])
    for values, files in groups.items():
        known = dict(values)
        part = spark.read.schema(stored).parquet(*files)
        parts.append(part.select(*(F.lit(known[f.name]).cast(f.dataType).alias(f.name) if f.name in known else F.col(f"`{f.name}`") for f in snap.schema.fields)))
    if not parts:
        return spark.createDataFrame([], snap.schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
