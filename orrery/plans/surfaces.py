"""Registered queries of what is not one SELECT: refusals, log guards, sessions, security, catalog, paged delivery, service.

Each gives facts as rows, which the SQL beside it states. Tables are made from those of sf_dir, whole.
"""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import SqlError
from ..sources.files import SharedPath
from .scenarios import fresh_engine, import_table, run

NATION = ("nation", "n_nationkey INT NOT NULL, n_name VARCHAR(25), n_regionkey INT", "SELECT n_nationkey, n_name, n_regionkey FROM src_nation")
SUPPLIER = ("supplier", "s_suppkey BIGINT, s_nationkey INT, s_acctbal FLOAT", "SELECT s_suppkey, s_nationkey, s_acctbal FROM src_supplier")


def facts(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def refused(e: Engine, sql: str, word: str) -> bool:
    """Whether the last statement fails and its message says the word."""
    last = e.execute_script(sql)[-1]
    return not last.success and word.lower() in last.message.lower()


def write_log(path: SharedPath, version: int, actions: list[dict]) -> None:
    (path / "_delta_log").mkdir()
    (path / "_delta_log" / f"{version:020d}.json").write_text("\n".join(map(json.dumps, actions)))


def schema_action(fields: list[tuple[str, str]], partitions: tuple[str, ...] = (), configuration: dict | None = None) -> dict:
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in fields]}
    return {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": json.dumps(schema), "partitionColumns": list(partitions), "configuration": configuration or {}}}


def add_actions(path: SharedPath, folder: str, values: dict | None = None) -> list[dict]:
    return [{"add": {"path": f"{folder}/{f.name}", "partitionValues": values or {}, "size": f.size(), "modificationTime": 0, "dataChange": True}} for f in (path / folder).glob("*.parquet")]


def delta_of_nations(spark: SparkSession, sf_dir: str, e: Engine) -> SharedPath:
    """A Delta table of nations: version 0 has regions 0 to 2, version 1 adds 3 and 4, version 2 removes 1."""
    path = e._path() / "tables" / "nations"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    adds = {}
    for r in range(5):
        nations.where(F.col("n_regionkey") == r).drop("n_regionkey").coalesce(1).write.parquet(str(path / f"n_regionkey={r}"))
        adds[r] = add_actions(path, f"n_regionkey={r}", {"n_regionkey": str(r)})
    head = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, schema_action([("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer")], ("n_regionkey",))]
    write_log(path, 0, head + adds[0] + adds[1] + adds[2])
    write_log(path, 1, adds[3] + adds[4])
    write_log(path, 2, [{"remove": {"path": a["add"]["path"], "dataChange": True}} for a in adds[1]])
    return path


def delta_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    delta_of_nations(spark, sf_dir, e)
    each = [e.table("nations", as_of=v).withColumn("version", F.lit(v)) for v in (0, 1, 2)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def delta_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with a checkpoint of version 1 in two parts, and the commits before it gone."""
    e = fresh_engine(spark)
    path = delta_of_nations(spark, sf_dir, e)
    log = path / "_delta_log"
    actions = [x for v in (0, 1) for x in (log / f"{v:020d}.json").read_text().splitlines()]
    shape = "protocol struct<minReaderVersion int, minWriterVersion int>, metaData struct<schemaString string, partitionColumns array<string>, configuration map<string,string>>, add struct<path string, partitionValues map<string,string>>"
    for i, lines in enumerate((actions[:3], actions[3:])):
        made = path / f"made{i}"
        spark.createDataFrame([(x,) for x in lines], "value STRING").select(F.from_json("value", shape).alias("a")).select("a.*").coalesce(1).write.parquet(str(made))
        next(made.glob("*.parquet")).rename(log / f"{1:020d}.checkpoint.{i + 1:010d}.{2:010d}.parquet")
        made.remove_tree()
    for v in (0, 1):
        (log / f"{v:020d}.json").unlink()
    return e.execute_query("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM nations GROUP BY n_regionkey").frame


def delta_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that need features which a snapshot reader lacks, and writes into a Delta table."""
    e = fresh_engine(spark)
    delta_of_nations(spark, sf_dir, e)
    cases = {
        "deletion vectors": {"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"]}},
        "column mapping": schema_action([("k", "integer")], configuration={"delta.columnMapping.mode": "name"}),
        "known feature": {"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["timestampNtz"]}},
    }
    rows = []
    for i, (name, action) in enumerate(cases.items()):
        write_log(e._path() / "tables" / f"odd{i}", 0, [schema_action([("k", "integer")]), action])
        rows.append((name, not e.execute_script(f"SELECT * FROM odd{i}")[-1].success))
    rows += [(f"{sql.split()[0].lower()} into it", refused(e, sql, "Delta")) for sql in ("INSERT INTO nations VALUES (1, 'x', 1)", "UPDATE nations SET n_name = 'x'", "DELETE FROM nations")]
    return facts(spark, "what STRING, refused BOOLEAN", rows)


def write_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single files and multi-part folders are read and not written; identity and computed columns take no values."""
    e = fresh_engine(spark)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    customers.repartition(3).write.parquet(str(e._path() / "tables" / "parts"))
    customers.coalesce(1).write.parquet(str(e._path() / "made"))
    next((e._path() / "made").glob("*.parquet")).rename(e._path() / "tables" / "single.parquet")
    run(e, "CREATE TABLE own (Id INT IDENTITY, V INT, W AS V * 2)")
    rows = [(f"{verb} {t}", refused(e, sql.format(t), "cannot be written")) for t in ("parts", "single") for verb, sql in (("insert", "INSERT INTO {} VALUES (1, 'x')"), ("update", "UPDATE {} SET c_name = 'x'"), ("delete", "DELETE FROM {}"))]
    rows += [("computed", refused(e, "INSERT INTO own (W) VALUES (1)", "computed")), ("identity", refused(e, "UPDATE own SET Id = 1", "cannot be updated")), ("read", not e.execute_query("SELECT COUNT(*) AS n FROM single s JOIN parts p ON p.c_custkey = s.c_custkey").success)]
    return facts(spark, "what STRING, refused BOOLEAN", rows)


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dialect refuses, with a word of the message."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    cases = {
        "date plus number": ("SELECT GETDATE() + 1", "DATEADD"), "star with group by": ("SELECT * FROM nation GROUP BY n_regionkey", "scalar select elements"), "scalar subquery of many rows": ("SELECT (SELECT n_name FROM nation) AS x", "more than one row"),
        "unknown column": ("SELECT nope FROM nation", "Invalid column"), "unknown table": ("SELECT 1 FROM nope", "does not exist"), "ambiguous name": ("SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", "ambiguous"),
        "undeclared variable": ("SELECT @x", "Must declare"), "top percent": ("SELECT TOP 5 PERCENT n_name FROM nation", "PERCENT"), "if": ("IF 1 = 1 SELECT 1", "Parse error"), "merge": ("MERGE nation", "Parse error"), "too few values": ("INSERT INTO nation VALUES (1)", "does not match"),
    }
    return facts(spark, "what STRING, refused BOOLEAN", [(k, refused(e, sql, word)) for k, (sql, word) in cases.items()])


def access_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a table that was queried has a time of its last query."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    import_table(e, sf_dir, *SUPPLIER)
    e.execute_query("SELECT COUNT(*) AS n FROM nation n WHERE EXISTS (SELECT 1 FROM src_supplier s WHERE s.s_nationkey = n.n_nationkey)")
    return facts(spark, "name STRING, queried BOOLEAN, rows LONG, kind STRING, columns STRING", [(t, i.last_queried is not None, i.row_count, i.kind, ",".join(f"{c.name} {c.declared}" for c in i.columns)) for t in ("nation", "supplier") for i in (e.get_table_info(t),)])


def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    r = e.execute_query("SELECT a.n_name, b.n_name, a.n_name, a.n_nationkey + 1, COUNT(*) AS n, b.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_name, b.n_name, a.n_nationkey, b.n_regionkey")
    return facts(spark, "place INT, name STRING", list(enumerate(r.columns)))


def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, *SUPPLIER)
    run(e, "SELECT s_nationkey AS nation, COUNT(*) AS n, MAX(s_acctbal) AS most INTO per_nation FROM supplier GROUP BY s_nationkey; DELETE FROM per_nation WHERE n < 2")
    return e.table("per_nation")


def update_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows of the joined table match a row: the one written last counts, not the largest."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, "part", "k BIGINT, size INT", "SELECT p_partkey, p_size FROM src_part")
    run(e, "CREATE TABLE step (r INT, v INT); INSERT INTO step VALUES (0, 900), (0, 2), (1, 7); INSERT INTO step VALUES (1, 3), (2, NULL); INSERT INTO step VALUES (0, 5)")
    run(e, "UPDATE p SET p.size = s.v FROM part p JOIN step s ON s.r = p.k % 4")
    return e.table("part")


def variables_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, "part", "k BIGINT, size INT", "SELECT p_partkey, p_size FROM src_part")
    return e.execute_query("DECLARE @n INT = 5, @least DECIMAL(9,2) = 10.5, @word VARCHAR(9) = 'size'; SET @n = @n * 2 + 1; SELECT TOP (@n) k, size, @word + '!' AS word FROM part WHERE size > @least ORDER BY size DESC, k").frame


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a script's statements, stopped at the failure and not; and the stored text of a procedure."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    script = "SELECT COUNT(*) AS n FROM nation\nGO\nSELECT 1/0 AS x\nGO\nSELECT n_name FROM nation WHERE n_regionkey = 1"
    rows = [(f"stops {i}", r.success, len(r.rows)) for i, r in enumerate(e.execute_script(script))]
    rows += [(f"goes on {i}", r.success, len(r.rows)) for i, r in enumerate(e.execute_script(script, continue_on_error=True))]
    run(e, "CREATE PROCEDURE names @r INT AS SELECT n_name FROM nation WHERE n_regionkey = @r")
    text = e.get_procedure_definition("work", "names")
    rows += [("definition", text.startswith("CREATE OR ALTER PROCEDURE names") and text.endswith("n_regionkey = @r"), len(e.execute_query("EXEC names 2").rows)), ("rendered", "(25 row(s) returned)" in e.execute_query("SELECT n_name FROM nation").render(), 0)]
    return facts(spark, "what STRING, worked BOOLEAN, n INT", rows)


def cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that would run for long is cancelled by its tag; the session works on."""
    e = fresh_engine(spark)
    said = []

    def work() -> None:
        e.cancellable("slow")
        try:
            r = e.execute_query("SELECT COUNT(*) AS n FROM sys.all_objects a CROSS JOIN sys.all_objects b CROSS JOIN sys.all_objects c WHERE a.object_id * b.object_id % 7 + c.object_id % 11 = -1")
            said.append(r.message)
        except Exception as x:
            said.append(str(x))

    thread = threading.Thread(target=work)
    thread.start()
    while thread.is_alive():
        thread.join(0.3)
        e.cancel("slow")
    spark.sparkContext.removeJobTag("slow")
    after = e.execute_query("SELECT COUNT(*) AS n FROM sys.all_objects").rows[0]["n"]
    return facts(spark, "cancelled BOOLEAN, after INT", [("cancel" in said[0].lower(), after)])


def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    run(e, "CREATE SCHEMA side; CREATE TABLE side.t (Id INT IDENTITY NOT NULL, P DECIMAL(12,2) NULL, Q AS P * 2); CREATE PROCEDURE p AS SELECT 1 AS one")
    return e.execute_query("""SELECT s.name + '.' + t.name AS tab, c.name AS col, c.column_id AS place, c.is_identity AS idn, c.is_computed AS comp, c.precision AS prec FROM sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.columns c ON c.object_id = t.object_id
        WHERE t.name IN ('nation', 't') UNION ALL SELECT 'procedure', name, 0, 0, 0, 0 FROM sys.procedures UNION ALL SELECT 'database', name, 0, 0, 0, 0 FROM sys.databases WHERE name = 'work' UNION ALL SELECT 'indexes', '', COUNT(*), 0, 0, 0 FROM sys.indexes""").frame


def security_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a login may do, step by step; DENY over GRANT, roles, schemas, ownership, visibility, impersonation."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    e.initialize_server("pw")
    run(e, "CREATE LOGIN kim WITH PASSWORD = 'k'; CREATE USER kim FOR LOGIN kim; CREATE SCHEMA side; CREATE TABLE side.t (A INT); CREATE ROLE crew; CREATE PROCEDURE p AS SELECT 1 AS one")
    kim = Engine(spark, e.root)
    rows = [("wrong password", kim.login("kim", "no")), ("login", kim.login("kim", "k"))]
    may = lambda sql: kim.execute_script("USE work; " + sql)[-1].success
    read, insert = "SELECT COUNT(*) AS n FROM nation", "INSERT INTO nation VALUES (99, 'x', 1)"
    steps = [
        ("nothing granted", "", read), ("granted", "GRANT SELECT ON nation TO kim", read), ("insert is another action", "", insert), ("denied on the database", "DENY SELECT ON DATABASE::work TO kim", read), ("revoked", "REVOKE SELECT ON DATABASE::work FROM kim", read),
        ("other schema", "", "SELECT * FROM side.t"), ("by role and schema", "ALTER ROLE crew ADD MEMBER kim; GRANT SELECT ON SCHEMA::side TO crew", "SELECT * FROM side.t"), ("every table of a query", "REVOKE SELECT ON nation FROM kim", "SELECT (SELECT COUNT(*) FROM nation) AS n FROM side.t"),
        ("fixed role", "ALTER ROLE db_datawriter ADD MEMBER kim", insert), ("procedure", "", "EXEC p"), ("procedure granted", "GRANT EXECUTE ON p TO kim", "EXEC p"), ("own schema", "CREATE SCHEMA own AUTHORIZATION kim", "CREATE TABLE own.x (A INT)"), ("grants nothing itself", "", "GRANT SELECT ON nation TO kim"), ("no new database", "", "CREATE DATABASE mine"),
    ]
    for what, grant, sql in steps:
        if grant:
            run(e, grant)
        rows.append((what, may(sql)))
    rows += [("sees", kim.can_view_object("work", "t", "side")), ("lists", kim.list_accessible_databases() == ["work"]), ("impersonated", e.execute_script("EXECUTE AS USER = 'kim'; SELECT * FROM nation")[-1].success), ("reverted", e.execute_script("REVERT; SELECT * FROM nation")[-1].success)]
    return facts(spark, "what STRING, allowed BOOLEAN", [(k, bool(v)) for k, v in rows])


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open stream does not see later changes; the NDJSON of a window; a Delta table's rows."""
    e = fresh_engine(spark)
    import_table(e, sf_dir, *SUPPLIER)
    stream = e.open_table_stream("work", "supplier", batch_size=7)
    run(e, "DELETE FROM supplier WHERE s_suppkey >= 3")
    rows = [("pinned", sum(len(b.rows) for b in stream)), ("now", e.open_table_stream("work", "supplier").total_rows)]
    lines = [json.loads(x) for x in e.open_table_stream("work", "supplier", batch_size=2, offset=1).ndjson()]
    rows += [("header", lines[0]["totalRows"]), ("kinds", int(lines[0]["types"] == ["int", "int", "dbl"])), ("batches", len(lines) - 1), ("first", lines[1]["start"])]
    delta_of_nations(spark, sf_dir, e)
    rows += [("delta", sum(len(b.rows) for b in e.open_table_stream("work", "nations", batch_size=3, offset=2))), ("beyond", sum(1 for _ in e.open_table_stream("work", "nations", offset=1000)))]
    return facts(spark, "what STRING, n INT", rows)


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST over HTTP and the prompt, on one root."""
    from ..repl import loop
    from ..server import Service, make_server

    e = fresh_engine(spark)
    import_table(e, sf_dir, *NATION)
    said: list[str] = []
    lines = iter(["SELECT COUNT(*) AS n", "FROM nation;", "SELECT n_name FROM nation WHERE n_nationkey < 2", "GO", "SELEC;", "quit"])
    loop(e, lambda prompt: next(lines), said.append)
    e.initialize_server("pw")
    server = make_server(Service(spark, str(e.root)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path: str, body: dict | None = None, token: str | None = None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(r, timeout=120) as f:
            return f.read().decode()

    try:
        token = json.loads(ask("login", {"login": "sa", "password": "pw"}))["token"]
        rows = [("prompt", "25" in said[1]), ("prompt rows", "(2 row(s) returned)" in said[2]), ("prompt error", "Parse error" in said[3]), ("databases", json.loads(ask("databases", token=token)) == ["work"])]
        rows += [("sql", json.loads(ask("sql", {"database": "work", "sql": "SELECT SUM(n_nationkey) AS s FROM nation"}, token))["rows"] == [{"s": 300}]), ("info", json.loads(ask("databases/work/tables/nation", token=token))["row_count"] == 25)]
        rows += [("stream", len(ask("databases/work/tables/nation/stream?offset=5&limit=20", token=token).splitlines()) == 2)]
        try:
            ask("databases")
            rows.append(("without a token", True))
        except urllib.error.HTTPError as x:
            rows.append(("without a token", x.code != 401))
    finally:
        server.shutdown()
    return facts(spark, "what STRING, worked BOOLEAN", rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (delta_time_travel, delta_checkpoint, delta_guards, write_guards, refusals, access_stats, result_names, select_into, update_last_match, variables_top, scripts, cancellation, catalog_views, security_rules, stream_snapshot, service)
}


def _says(columns: str, rows: list[tuple]) -> str:
    """SQL of constant rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


ORACLE_SQL = {
    "delta_time_travel": "SELECT n_nationkey, n_name, n_regionkey, version FROM nation, range(3) AS v(version) WHERE n_regionkey < 3 AND (version < 2 OR n_regionkey <> 1) OR n_regionkey >= 3 AND version > 0",
    "delta_checkpoint": "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation WHERE n_regionkey <> 1 GROUP BY n_regionkey",
    "delta_guards": _says("what, refused", [("deletion vectors", True), ("column mapping", True), ("known feature", False), ("insert into it", True), ("update into it", True), ("delete into it", True)]),
    "write_guards": _says("what, refused", [*((f"{v} {t}", True) for t in ("parts", "single") for v in ("insert", "update", "delete")), ("computed", True), ("identity", True), ("read", False)]),
    "refusals": _says("what, refused", [(k, True) for k in ("date plus number", "star with group by", "scalar subquery of many rows", "unknown column", "unknown table", "ambiguous name", "undeclared variable", "top percent", "if", "merge", "too few values")]),
    "access_stats": "SELECT 'nation' AS name, true AS queried, (SELECT count(*) FROM nation) AS rows, 'managed' AS kind, 'n_nationkey int,n_name varchar,n_regionkey int' AS columns UNION ALL SELECT 'supplier', false, (SELECT count(*) FROM supplier), 'managed', 's_suppkey bigint,s_nationkey int,s_acctbal float'",
    "result_names": _says("place, name", list(enumerate(["a.n_name", "b.n_name", "a.n_name_2", "column", "n", "n_regionkey"]))),
    "select_into": "SELECT s_nationkey AS nation, count(*) AS n, max(s_acctbal) AS most FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2",
    "update_last_match": "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE p_size END AS size FROM part",
    "variables_top": "SELECT p_partkey AS k, p_size AS size, 'size!' AS word FROM part WHERE p_size > 10.5 ORDER BY p_size DESC, p_partkey LIMIT 11",
    "scripts": _says("what, worked, n", [("stops 0", True, 1), ("stops 1", False, 0), ("goes on 0", True, 1), ("goes on 1", False, 0), ("goes on 2", True, 5), ("definition", True, 5), ("rendered", True, 0)]),
    "cancellation": "SELECT true AS cancelled, 2000 AS after",
    "catalog_views": _says("tab, col, place, idn, comp, prec", [("dbo.nation", "n_nationkey", 1, 0, 0, 0), ("dbo.nation", "n_name", 2, 0, 0, 25), ("dbo.nation", "n_regionkey", 3, 0, 0, 0), ("side.t", "Id", 1, 1, 0, 0), ("side.t", "P", 2, 0, 0, 12), ("side.t", "Q", 3, 0, 1, 38), ("procedure", "p", 0, 0, 0, 0), ("database", "work", 0, 0, 0, 0), ("indexes", "", 0, 0, 0, 0)]),
    "security_rules": _says("what, allowed", [
        ("wrong password", False), ("login", True), ("nothing granted", False), ("granted", True), ("insert is another action", False), ("denied on the database", False), ("revoked", True), ("other schema", False), ("by role and schema", True), ("every table of a query", False), ("fixed role", True),
        ("procedure", False), ("procedure granted", True), ("own schema", True), ("grants nothing itself", False), ("no new database", False), ("sees", True), ("lists", True), ("impersonated", False), ("reverted", True),
    ]),
    "stream_snapshot": "WITH s AS (SELECT count(*)::INT AS n FROM supplier), v(what, n) AS (VALUES ('now', 3), ('header', 3), ('kinds', 1), ('batches', 1), ('first', 1), ('beyond', 0)) SELECT 'pinned' AS what, n FROM s UNION ALL SELECT * FROM v UNION ALL SELECT 'delta', (count(*) - 2)::INT FROM nation WHERE n_regionkey <> 1",
    "service": _says("what, worked", [("prompt", True), ("prompt rows", True), ("prompt error", True), ("databases", True), ("sql", True), ("info", True), ("stream", True), ("without a token", False)]),
}
