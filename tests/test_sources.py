import json

import pytest
from pyspark.sql import functions as F

from orrery.operators.column_math import Predicate, column_count, column_sum
from orrery.sources.delta import snapshot
from orrery.sources.tables import part_order


def test_multi_part_tables(engine, rows, fails, spark):
    folder = engine._path() / "tables" / "parts"
    for i, n in ((10, 3), (2, 2)):
        spark.createDataFrame([(i, k) for k in range(n)], "part INT, k INT").coalesce(1).write.parquet(str(folder.parent / f"w{i}"))
        folder.mkdir(exist_ok=True)
        next((folder.parent / f"w{i}").glob("*.parquet")).rename(folder / f"part-{i}.parquet")
    assert [p.name for p in sorted(folder.glob("*"), key=part_order)] == ["part-2.parquet", "part-10.parquet"]
    assert rows("SELECT COUNT(*), MAX(part) FROM parts") == [(5, 10)]
    assert "multi-part" in fails("INSERT INTO parts VALUES (1, 2)")
    batches = list(engine.open_table_stream("lab", "parts", batch_size=2, offset=1, limit=3))
    assert [(b.start, [r["part"] for r in b.rows]) for b in batches] == [(1, [2, 10]), (3, [10])]


def write_delta(engine, spark, name, commits, parts=()):
    path = engine._path() / "tables" / name
    (path / "_delta_log").mkdir(parents=True)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "k INT").coalesce(1).write.parquet(str(path / f"w{i}"))
        next((path / f"w{i}").glob("*.parquet")).rename(path / f"f{i}.parquet")
    for v, actions in enumerate(commits):
        (path / "_delta_log" / f"{v:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    return path


SCHEMA = json.dumps({"type": "struct", "fields": [{"name": "k", "type": "integer", "nullable": True, "metadata": {}}]})
META = {"metaData": {"schemaString": SCHEMA, "partitionColumns": [], "configuration": {}}}


def test_delta_replay(engine, rows, fails, spark):
    path = write_delta(engine, spark, "d", [[META, {"add": {"path": "f0.parquet", "partitionValues": {}}}, {"add": {"path": "f1.parquet", "partitionValues": {}}}], [{"remove": {"path": "f0.parquet"}}]], [[(1,), (2,)], [(3,)]])
    assert rows("SELECT k FROM d") == [(3,)]
    assert sorted(snapshot(spark, path, 0).files) == ["f0.parquet", "f1.parquet"]
    assert "Delta" in fails("INSERT INTO d VALUES (1)")
    assert [b.rows for b in engine.open_table_stream("lab", "d")] == [[{"k": 3}]]


def test_delta_checkpoint_keeps_schema_and_protocol(engine, rows, spark):
    path = write_delta(engine, spark, "c", [], [[(1,)], [(2,)]])
    actions = [META, {"add": {"path": "f0.parquet", "partitionValues": {}}}]
    (path / "cp.json").write_text("\n".join(map(json.dumps, actions)))
    spark.read.schema("metaData struct<schemaString string, partitionColumns array<string>, configuration map<string,string>>, add struct<path string, partitionValues map<string,string>>").json(str(path / "cp.json")).coalesce(1).write.parquet(str(path / "w"))
    next((path / "w").glob("*.parquet")).rename(path / "_delta_log" / f"{3:020d}.checkpoint.parquet")
    (path / "_delta_log" / f"{4:020d}.json").write_text(json.dumps({"add": {"path": "f1.parquet", "partitionValues": {}}}))
    assert sorted(rows("SELECT k FROM c")) == [(1,), (2,)]


@pytest.mark.parametrize("action, word", [({"protocol": {"minReaderVersion": 3, "readerFeatures": ["deletionVectors"]}}, "deletionVectors"), ({"metaData": {"schemaString": SCHEMA, "configuration": {"delta.columnMapping.mode": "name"}}}, "column mapping")])
def test_delta_features_that_are_refused(engine, fails, spark, action, word):
    write_delta(engine, spark, "bad", [[META, action]])
    assert word in fails("SELECT * FROM bad")


def test_streams_are_snapshots(engine, rows):
    rows("CREATE TABLE n (Id INT IDENTITY, V INT); INSERT INTO n (V) SELECT TOP (120) object_id FROM sys.all_objects ORDER BY object_id")
    stream = engine.open_table_stream("lab", "n", batch_size=50)
    rows("DELETE FROM n WHERE Id > 10; INSERT INTO n (V) VALUES (7)")
    got = list(stream)
    assert [len(b.rows) for b in got] == [50, 50, 20] and [b.start for b in got] == [0, 50, 100]
    lines = list(engine.open_table_stream("lab", "n").ndjson())
    assert json.loads(lines[0]) == {"columns": ["Id", "V"], "types": ["int", "int"], "totalRows": 11}
    assert list(engine.open_table_stream("lab", "n", offset=500)) == []


def test_table_info(engine, rows):
    rows("CREATE TABLE w (Id INT IDENTITY NOT NULL, P DECIMAL(12,2) NULL); INSERT INTO w (P) VALUES (1), (2); SELECT * FROM w")
    info = engine.get_table_info("w")
    assert (info.row_count, info.kind, [c.declared for c in info.columns], info.columns[1].args) == (2, "managed", ["int", "decimal"], [12, 2])
    assert info.last_queried and info.size_bytes > 0


def test_column_math(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x DOUBLE")
    assert column_sum(df, "x").first().total == 6 and column_sum(df.limit(0), "x").first().total == 0
    assert column_sum(df, "x", Predicate.GREATER, 1).first().total == 5
    assert [column_count(df, "x", p, 2).first().n for p in (Predicate.ALL, Predicate.LESS, Predicate.LESS_OR_EQUAL, Predicate.EQUAL, Predicate.GREATER_OR_EQUAL)] == [3, 1, 2, 1, 2]


def test_plans_push_down_and_prune(spark, tmp_path):
    from orrery.engine import run_over

    spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("wide")).write.parquet(str(tmp_path / "t.parquet"))
    plan = run_over(spark, str(tmp_path), "SELECT k, COUNT(*) AS n FROM t WHERE id > 500 GROUP BY k")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan and "GreaterThan(id,500)" in plan and "partial_count" in plan
