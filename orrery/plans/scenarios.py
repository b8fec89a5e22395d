"""Registered queries that need a database of their own: DML, procedures, multi-part and Delta tables, paged reads.

Each makes its database in a new folder below spark.checkpoint.dir (a temporary one where that is unset)
from the tables of sf_dir, which are never written.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import SqlError


def fresh_engine(spark: SparkSession) -> Engine:
    """An engine with an empty database `work`, in a folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark._jsc.sc().isLocal():
            raise SqlError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        top = tempfile.mkdtemp(prefix="orrery-")
    engine = Engine(spark, f"{top.rstrip('/')}/work-{uuid.uuid4().hex}")
    run(engine, "CREATE DATABASE work; USE work")
    return engine


def run(engine: Engine, sql: str):
    for r in engine.execute_script(sql):
        if not r.success:
            raise SqlError(r.message)
    return r


def import_table(engine: Engine, sf_dir: str, name: str, columns: str, select: str) -> None:
    """A writable table of the columns, filled from `select` over a table of sf_dir that is linked as an external part."""
    source = engine.spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source.write.parquet(str(engine._path() / "parquet" / f"src_{name}"))
    run(engine, f"CREATE TABLE {name} ({columns}); INSERT INTO {name} {select}")


ORDERS = "o_orderkey BIGINT NOT NULL PRIMARY KEY, o_custkey BIGINT, o_orderstatus CHAR(1), o_totalprice FLOAT, o_orderdate DATETIME2, o_orderpriority VARCHAR(20)"
SELECT_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM src_orders"


def insert_select_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "orders", ORDERS, SELECT_ORDERS)
    return e.table("orders")


def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "orders", ORDERS, SELECT_ORDERS)
    import_table(e, sf_dir, "customer", "c_custkey BIGINT, c_mktsegment VARCHAR(20)", "SELECT c_custkey, c_mktsegment FROM src_customer")
    run(e, "UPDATE o SET o.o_totalprice = 0, o.o_orderpriority = c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'; UPDATE orders SET o_totalprice += 1 WHERE o_orderstatus = 'P'")
    return e.table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "orders", ORDERS, SELECT_ORDERS)
    run(e, "DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < (SELECT AVG(o_totalprice) FROM orders)")
    return e.table("orders").select("o_orderkey", "o_orderstatus")


def computed_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "part", "k BIGINT, size INT", "SELECT p_partkey, p_size FROM src_part")
    run(e, "CREATE TABLE made (id INT IDENTITY(10, 5), k BIGINT, size INT, note VARCHAR(10) DEFAULT 'new', twice AS size * 2 PERSISTED); INSERT INTO made (k, size) SELECT k, size FROM part; INSERT INTO made (k, size, note) VALUES (-1, 1, 'x'), (-2, NULL, NULL)")
    return e.table("made").groupBy("note").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("twice").alias("twice"))


def proc_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "orders", ORDERS, SELECT_ORDERS)
    run(e, "CREATE OR ALTER PROCEDURE totals @status CHAR(1), @least FLOAT = 0, @n INT = 0 OUTPUT AS BEGIN SET @n = (SELECT COUNT(*) FROM orders WHERE o_orderstatus = @status AND o_totalprice >= @least); SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = @status AND o_totalprice >= @least GROUP BY o_orderpriority END")
    rows = e.execute_query("EXEC totals @status = 'O', @least = 50000")
    out = e.execute_query("DECLARE @n INT; EXEC totals 'F', 0, @n OUTPUT; SELECT 'all F' AS o_orderpriority, CAST(@n AS BIGINT) AS n")
    return rows.frame.unionByName(out.frame)


def multipart_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(11, "c_custkey").write.parquet(str(e._path() / "tables" / "customer"))
    return e.execute_query("SELECT c_nationkey, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey").frame


def delta_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Delta table partitioned by region, with a file removed and a region without a name."""
    e = fresh_engine(spark)
    path = e._path() / "tables" / "nations"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    adds = []
    for r in range(5):
        folder = path / f"n_regionkey={r}"
        nations.where(F.col("n_regionkey") == r).drop("n_regionkey").coalesce(1).write.parquet(str(folder))
        adds += [{"add": {"path": f"n_regionkey={r}/{f.name}", "partitionValues": {"n_regionkey": str(r) if r else None}, "size": f.size(), "modificationTime": 0, "dataChange": True}} for f in folder.glob("*.parquet")]
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer"))]}
    log = path / "_delta_log"
    log.mkdir()
    head = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": json.dumps(schema), "partitionColumns": ["n_regionkey"], "configuration": {}}}]
    (log / f"{0:020d}.json").write_text("\n".join(map(json.dumps, head + adds)))
    gone = [{"remove": {"path": a["add"]["path"], "dataChange": True}} for a in adds if a["add"]["partitionValues"]["n_regionkey"] == "3"]
    (log / f"{1:020d}.json").write_text("\n".join(map(json.dumps, gone)))
    return e.table("nations")


def stream_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 95 to 194 of a table, in batches of 40, as the paged reader gives them."""
    e = fresh_engine(spark)
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").write.parquet(str(e._path() / "tables" / "part"))
    stream = e.open_table_stream("work", "part", batch_size=40, offset=95, limit=100)
    rows = [(b.start + i, r["p_partkey"], r["p_name"]) for b in stream for i, r in enumerate(b.rows)]
    return spark.createDataFrame(rows, "place LONG, p_partkey LONG, p_name STRING")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (insert_select_roundtrip, update_from, delete_where, computed_identity, proc_exec, multipart_read, delta_snapshot, stream_page)}

ORACLE_SQL = {
    "insert_select_roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    "update_from": "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE o_totalprice END + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_totalprice, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "delete_where": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < (SELECT avg(o_totalprice) FROM orders))",
    "computed_identity": "WITH n AS (SELECT count(*) AS n, sum(p_size) * 2 AS twice FROM part) SELECT 'new' AS note, n, n AS ids, 10::INT AS lo, (10 + 5 * (n - 1))::INT AS hi, twice::BIGINT AS twice FROM n UNION ALL SELECT 'x', 1, 1, (10 + 5 * n)::INT, (10 + 5 * n)::INT, 2 FROM n UNION ALL SELECT NULL, 1, 1, (15 + 5 * n)::INT, (15 + 5 * n)::INT, NULL FROM n",
    "proc_exec": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 50000 GROUP BY o_orderpriority UNION ALL SELECT 'all F', count(*) FROM orders WHERE o_orderstatus = 'F'",
    "multipart_read": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey",
    "delta_snapshot": "SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 0 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 3",
    "stream_page": "SELECT place, p_partkey, p_name FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey, p_name FROM part) WHERE place BETWEEN 95 AND 194",
}
