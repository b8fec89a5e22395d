"""The engine: sessions that run T-SQL on Spark over databases of Parquet tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField

from .errors import ParseError, PermissionDenied, SqlError
from .functions.scalars import quote
from .functions.types import kind_of, kind_of_declared, spark_type
from .operators import dml
from .plans import syntax as s
from .plans.lowering import Columns, Lowering, Scope, Source, Value, display_names, ident
from .plans.parser import parse_expression, parse_script
from .result import QueryResult
from .security import DatabaseSecurity, Identity, ServerSecurity
from .sources import sysviews
from .sources.files import SharedPath, plain_path
from .sources.tables import LOCKS, AccessStats, Column, TableRef, TableStore, now_text
from .streaming.pages import DEFAULT_BATCH, TableStream, open_stream

SYSTEM_DATABASES = {"master", "tempdb", "model", "msdb"}
MOST_NESTING = 32


def lower_query(spark: SparkSession, query: Any, resolve: Callable[[s.Name], DataFrame], variables: dict | None = None, database: str = "", two_valued: bool = False) -> tuple[str, Columns, list]:
    """Spark SQL text of a query over tables that resolve gives as DataFrames."""
    known: dict[int, tuple[str, Columns]] = {}

    def table(name: s.Name) -> tuple[str, Columns]:
        df = resolve(name)
        if id(df) not in known:
            view = f"__orrery_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(view)
            known[id(df)] = (view, [(f.name, kind_of(f.dataType)) for f in df.schema.fields], df)  # type: ignore[assignment]
        return known[id(df)][0], known[id(df)][1]

    out = Lowering(table, variables, database, two_valued).query(query)
    return out.sql, out.columns, out.sources


class FolderTables:
    """Tables that are `<folder>/<name>.parquet`, wherever Spark can read them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._known = spark, folder.rstrip("/"), {}

    def __call__(self, name: s.Name) -> DataFrame:
        key = name[-1].lower()
        if key not in self._known:
            self._known[key] = sysviews.generator(self.spark) if len(name) > 1 and name[-2].lower() == "sys" else self.spark.read.parquet(f"{self.folder}/{key}.parquet")
        return self._known[key]


def run_over(spark: SparkSession, folder: str, sql: str, two_valued: bool = False) -> DataFrame:
    """The result of one T-SQL query over a folder of Parquet tables, as a lazy DataFrame."""
    batches = parse_script(sql)
    if len(batches) != 1 or len(batches[0]) != 1 or not isinstance(batches[0][0], s.SelectStatement):
        raise SqlError("One query is needed.")
    text, columns, sources = lower_query(spark, batches[0][0].query, FolderTables(spark, folder), two_valued=two_valued)
    df = spark.sql(text)
    return df.toDF(*display_names(columns, sources))


def column_of(f: StructField) -> Column:
    """A column as a file's schema has it."""
    names = {"int": "int", "dec": "decimal", "dbl": "float", "ts": "datetime", "bool": "bit"}
    args = [f.dataType.precision, f.dataType.scale] if isinstance(f.dataType, DecimalType) else []
    return Column(f.name, names.get(kind_of(f.dataType), "nvarchar"), args, f.nullable, spark=f.dataType.simpleString())


@dataclass
class TableInfo:
    schema: str
    name: str
    kind: str
    row_count: int
    size_bytes: int
    parts: int
    created: str | None
    changed: str | None
    schema_changed: str | None
    last_queried: str | None
    columns: list[Column]
    permissions: list[dict]


class Engine:
    """One session. Statements of a session run one at a time; any number of sessions may share a data root."""

    def __init__(self, spark: SparkSession, data_root: str | os.PathLike, two_valued: bool = False) -> None:
        self.spark, self.root, self.two_valued = spark, SharedPath(spark, data_root), two_valued
        (self.root / "databases").mkdir()
        (self.root / "system").mkdir()
        self.server = ServerSecurity(self.root)
        self.identity = Identity(self.server)
        self.current: str | None = None
        self._tag: str | None = None

    # databases
    def _db_path(self, name: str) -> SharedPath | None:
        for p in (self.root / "databases").iterdir():
            if p.is_dir() and p.name.lower() == name.lower():
                return p
        return None

    @property
    def database(self) -> str:
        if self.current is None:
            raise SqlError("No database selected. Run USE <database> first.")
        return self.current

    def _path(self, database: str | None = None) -> SharedPath:
        name = database or self.database
        path = self._db_path(name)
        if path is None:
            raise SqlError(f"Database '{name}' does not exist.")
        return path

    @property
    def store(self) -> TableStore:
        return TableStore(self._path())

    @property
    def security(self) -> DatabaseSecurity:
        return DatabaseSecurity(self._path())

    def database_created(self, name: str) -> datetime:
        mark = self._path(name) / "database.json"
        return datetime.fromisoformat(json.loads(mark.read_text())["created"]).replace(microsecond=0, tzinfo=None) if mark.exists() else datetime.fromtimestamp(int(self._path(name).modified()))

    def _may_use(self, name: str) -> bool:
        return self.identity.is_admin or self.identity.user(DatabaseSecurity(self._path(name))) is not None

    def list_accessible_databases(self) -> list[str]:
        return sorted(p.name for p in (self.root / "databases").iterdir() if p.is_dir() and self._may_use(p.name))

    # logins
    def initialize_server(self, default_password: str) -> bool:
        """Makes the admin login, unless there is a login already."""
        if self.server.logins():
            return False
        self.server.create_login("sa", default_password)
        self.server.set_member("sysadmin", "sa", True)
        return True

    def login(self, name: str, password: str) -> bool:
        if not self.server.check(name, password):
            return False
        self.resume_login(name)
        return True

    def resume_login(self, name: str) -> None:
        found = self.server.find(name)
        if found is None or found["disabled"]:
            raise SqlError(f"Login '{name}' does not exist.")
        self.identity, self.current = Identity(self.server), None
        self.identity.login = found["name"]

    def logout(self) -> None:
        self.identity, self.current = Identity(self.server), None

    def list_server_logins(self) -> list[dict]:
        return [{"name": x["name"], "disabled": x["disabled"], "is_sysadmin": "sysadmin" in self.server.roles(x["name"])} for x in self.server.logins()]

    def list_server_roles(self) -> list[dict]:
        from .security import SERVER_ROLES

        return [{"name": r, "members": self.server.members(r)} for r in SERVER_ROLES]

    def grant_database_access(self, database: str, login: str, roles: list[str] | None = None) -> None:
        """Makes a user for the login, if there is none, and adds it to roles."""
        db = DatabaseSecurity(self._path(database))
        if not self.identity.is_admin and not (self.identity.user(db) and db.manages(self.identity.user(db))):
            raise PermissionDenied("Permission denied: managing users.")
        if self.server.find(login) is None:
            raise SqlError(f"Login '{login}' does not exist.")
        if db.user_of(login) is None:
            db.create_user(login, login)
        for r in roles or []:
            db.set_member(r, db.user_of(login), True)

    def can_read_table(self, database: str, table: str, schema: str = "dbo") -> bool:
        db = DatabaseSecurity(self._path(database))
        user = self.identity.user(db)
        return self.identity.is_admin or (user is not None and db.allows(user, "SELECT", schema, table))

    def can_view_object(self, database: str, name: str, schema: str = "dbo") -> bool:
        db = DatabaseSecurity(self._path(database))
        user = self.identity.user(db)
        return self.identity.is_admin or (user is not None and db.sees(user, schema, name))

    def get_my_permissions(self, database: str) -> list[dict]:
        db = DatabaseSecurity(self._path(database))
        user = self.identity.user(db)
        return [p for p in db.state()["permissions"] if user and p["grantee"].lower() in db.principals(user)]

    # running
    def execute_query(self, sql: str) -> QueryResult:
        """Runs all statements of the text and gives the last result that has columns, or the last one; stops at a failure."""
        results = self.execute_script(sql)
        if results and not results[-1].success:
            return results[-1]
        return next((r for r in reversed(results) if r.columns), results[-1] if results else QueryResult())

    def execute_script(self, sql: str, continue_on_error: bool = False) -> list[QueryResult]:
        """One result for each statement. Variables live until the end of the text, GO or not."""
        try:
            batches = parse_script(sql)
        except ParseError as e:
            return [QueryResult(success=False, message=str(e))]
        run, out = _Run(self), []
        for statement in (x for b in batches for x in b):
            out.append(run.guarded(statement))
            if not out[-1].success and not continue_on_error:
                break
        return out

    def execute_script_file(self, path: str | os.PathLike, continue_on_error: bool = False) -> list[QueryResult]:
        return self.execute_script(Path(path).read_text(encoding="utf-8-sig"), continue_on_error)

    def cancellable(self, tag: str) -> None:
        """Jobs that this thread starts from now on end when cancel(tag) is called from another."""
        context = self.spark.sparkContext
        if self._tag:
            context.removeJobTag(self._tag)
        self._tag = tag
        context.addJobTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)

    # tables
    def table(self, name: str, schema: str = "dbo", as_of: int | None = None) -> DataFrame:
        """A table's rows; with as_of, those of that version of a Delta table."""
        return self.resolve((schema, name), as_of)

    def _ref(self, name: s.Name, action: str) -> tuple[TableStore, TableRef]:
        """A table by name of one to four parts; the database part is honoured."""
        table, schema = name[-1], name[-2] if len(name) > 1 else "dbo"
        path = self._path(name[-3] if len(name) > 2 else None)
        if len(name) > 2 and not self._may_use(path.name):
            raise PermissionDenied(f"The login does not have access to database '{path.name}'.")
        self.identity.require(DatabaseSecurity(path), action, schema, table)
        store = TableStore(path)
        ref = store.find(schema, table)
        if ref is None:
            raise SqlError(f"Table '{'.'.join(name)}' does not exist.")
        return store, ref

    def resolve(self, name: s.Name, as_of: int | None = None) -> DataFrame:
        if len(name) > 1 and name[-2].lower() == "sys":
            found = sysviews.view(self.spark, name[-1], self)
            if found is None:
                raise SqlError(f"View 'sys.{name[-1]}' does not exist.")
            return found
        store, ref = self._ref(name, "SELECT")
        AccessStats(store.root).stamp(ref.schema, ref.name)
        return ref.read(self.spark, as_of)

    def has_files(self, name: s.Name) -> bool:
        """Whether rows of the table have a place in a file that a query can ask for."""
        if len(name) > 1 and name[-2].lower() == "sys":
            return False
        ref = TableStore(self._path(name[-3] if len(name) > 2 else None)).find(name[-2] if len(name) > 1 else "dbo", name[-1])
        return ref is not None and ref.kind != "delta" and not (ref.manifest and not ref.manifest.parts)

    def table_columns(self, schema: str, name: str) -> list[Column]:
        ref = self.store.find(schema, name)
        if ref.manifest:
            return ref.manifest.columns
        return [column_of(f) for f in ref.read(self.spark).schema.fields]

    def get_table_info(self, table: str, schema: str = "dbo", database: str | None = None) -> TableInfo:
        before = self.current
        try:
            self.current = database or self.database
            if not self.can_view_object(self.current, table, schema):
                raise PermissionDenied(f"Permission denied: VIEW DEFINITION on '{schema}.{table}'.")
            ref = self.store.find(schema, table)
            if ref is None:
                raise SqlError(f"Table '{table}' does not exist.")
            files = [] if ref.kind == "delta" else ref.files()
            m = ref.manifest
            scope = {f"{schema}.{table}".lower(), schema.lower(), ""}
            granted = [p for p in self.security.state()["permissions"] if p["class"] == "DATABASE" or p["securable"].lower() in scope]
            stamp = datetime.fromtimestamp(ref.path.modified()).isoformat()
            return TableInfo(
                schema, table, ref.kind, ref.read(self.spark).count(), sum(SharedPath(self.spark, f).size() for f in files), len(files), m.created if m else stamp, m.changed if m else stamp,
                m.schema_changed if m else stamp, AccessStats(self.store.root).read().get(f"{schema}.{table}".lower()), self.table_columns(schema, table), granted,
            )
        finally:
            self.current = before

    def open_table_stream(self, database: str, table: str, schema: str = "dbo", batch_size: int = DEFAULT_BATCH, offset: int = 0, limit: int | None = None) -> TableStream:
        if not self.can_read_table(database, table, schema):
            raise PermissionDenied(f"Permission denied: SELECT on '{schema}.{table}'.")
        ref = TableStore(self._path(database)).find(schema, table)
        if ref is None:
            raise SqlError(f"Table '{table}' does not exist.")
        return open_stream(self.spark, ref, batch_size, offset, limit)

    # procedures
    def _procedure_path(self, name: s.Name) -> SharedPath:
        stem = name[-1] if len(name) < 2 or name[-2].lower() == "dbo" else f"{name[-2]}.{name[-1]}"
        folder = self._path() / "procedures"
        return next((p for p in folder.glob("*.json") if p.stem.lower() == stem.lower()), folder / f"{stem}.json")

    def procedure_names(self) -> list[str]:
        return sorted(p.stem for p in (self._path() / "procedures").glob("*.json"))

    def get_procedure_definition(self, database: str, procedure: str, schema: str = "dbo") -> str:
        path = self._path(database) / "procedures" / f"{procedure if schema.lower() == 'dbo' else f'{schema}.{procedure}'}.json"
        if not path.exists():
            raise SqlError(f"Procedure '{procedure}' does not exist.")
        return json.loads(path.read_text())["definition"]


class _Run:
    """The statements of one text, with their variables."""

    def __init__(self, engine: Engine, nesting: int = 0) -> None:
        self.engine, self.spark, self.nesting = engine, engine.spark, nesting
        self.variables: dict[str, tuple[str, str]] = {}
        self.types: dict[str, s.TypeName] = {}
        if nesting > MOST_NESTING:
            raise SqlError("Procedures are nested too deep.")

    def guarded(self, statement: s.Statement) -> QueryResult:
        try:
            out = self.run(statement)
        except SqlError as e:
            out = QueryResult(success=False, message=str(e))
        except Exception as e:  # what Spark says of a query
            if "JOB_CANCELLED" in str(e) or "cancelled job tag" in str(e):
                raise
            out = QueryResult(success=False, message=str(e).split("\n\nJVM stacktrace")[0])
        out.statement = statement.text
        return out

    def run(self, st: s.Statement) -> QueryResult:
        return getattr(self, f"_{type(st).__name__.lower()}")(st)

    # queries
    def lowering(self, resolve: Callable[[s.Name], DataFrame] | None = None) -> Lowering:
        frames: dict[int, tuple] = {}

        def table(name: s.Name) -> tuple[str, Columns]:
            df = (resolve or self.engine.resolve)(name)
            view = f"__orrery_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(view)
            frames[id(df)] = (df, view)
            return view, [(f.name, kind_of(f.dataType)) for f in df.schema.fields]

        return Lowering(table, self.variables, self.engine.current or "", self.engine.two_valued)

    def frame(self, query: Any, resolve: Callable | None = None) -> tuple[DataFrame, list[str]]:
        out = self.lowering(resolve).query(query)
        df = self.spark.sql(out.sql)
        return df, display_names(out.columns, out.sources)

    def _select_into(self, name: s.Name, query: Any) -> QueryResult:
        """A new table with the columns of the query's result."""
        e = self.engine
        schema, table = name[-2] if len(name) > 1 else "dbo", name[-1]
        if e.security.schema(schema) is None:
            raise SqlError(f"Schema '{schema}' does not exist.")
        e.identity.require(e.security, "ALTER", schema, table)
        df, names = self.frame(query)
        df = df.toDF(*names)
        e.store.create(schema, table, [column_of(f) for f in df.schema.fields])
        ref = e.store.find(schema, table)
        return QueryResult(message=f"{dml.append(e.store, ref, df)} row(s) inserted into [{table}].")

    def _selectstatement(self, st: s.SelectStatement) -> QueryResult:
        body = st.query.body if isinstance(st.query, s.With) else st.query
        if isinstance(body, s.Select) and body.into:
            return self._select_into(body.into, st.query)
        df, names = self.frame(st.query)
        df = df.toDF(*names)
        rows = [dict(zip(names, r)) for r in df.collect()]
        return QueryResult(names, f"({len(rows)} row(s) returned)", True, df, _rows=rows)

    def scalar(self, e: Any) -> Any:
        """The value of an expression without a row; subqueries run."""
        sql, kind = self.lowering().value(e, Scope())
        return self.spark.sql(f"SELECT {sql} AS v").first().v

    def literal(self, value: Any, kind: s.TypeName) -> Value:
        return Value(self._literal(value, kind), value)

    def _literal(self, value: Any, kind: s.TypeName) -> tuple[str, str]:
        k = kind_of_declared(kind)
        if value is None:
            return f"CAST(NULL AS {'BOOLEAN' if k == 'bool' else spark_type(kind)})", k
        if k == "bool":
            return ("true" if value else "false"), k
        if k in ("str", "ts"):
            return (quote(str(value)) if k == "str" else f"CAST({quote(str(value))} AS TIMESTAMP_NTZ)"), k
        return f"CAST({value} AS {spark_type(kind)})", k

    def assign(self, name: str, kind: s.TypeName, e: Any) -> None:
        low = self.lowering()
        value = None
        if e is not None:
            sql, _ = low.cast(low.value(e, Scope()), kind)
            value = self.spark.sql(f"SELECT {sql} AS v").first().v
        self.types[name.lower()] = kind
        self.variables[name.lower()] = self.literal(value, kind)

    def _declare(self, st: s.Declare) -> QueryResult:
        for name, kind, e in st.items:
            self.assign(name, kind, e)
        return QueryResult(message="Command completed.")

    def _setvariable(self, st: s.SetVariable) -> QueryResult:
        if st.name.lower() not in self.variables:
            raise SqlError(f'Must declare the scalar variable "{st.name}".')
        self.assign(st.name, self.types[st.name.lower()], st.value)
        return QueryResult(message="Command completed.")

    def _noop(self, st: s.NoOp) -> QueryResult:
        return QueryResult(message=f"{st.what}: nothing to do.")

    def _block(self, st: s.Block) -> QueryResult:
        out = QueryResult(message="Command completed.")
        for x in st.statements:
            now = self.run(x)
            out = now if now.columns or not out.columns else out
        return out

    # databases and schemas
    def _createdatabase(self, st: s.CreateDatabase) -> QueryResult:
        e = self.engine
        if not e.identity.has_server_role("sysadmin", "dbcreator"):
            raise PermissionDenied("The login does not have permission to create databases.")
        if e._db_path(st.name) is not None:
            raise SqlError(f"Database '{st.name}' already exists.")
        path = e.root / "databases" / st.name
        for folder in ("tables", "views", "procedures", "functions", "security", "users", "parquet"):
            (path / folder).mkdir()
        (path / "database.json").write_text(json.dumps({"created": now_text()}))
        if e.identity.login:
            db = DatabaseSecurity(path)
            db.create_user(e.identity.login, e.identity.login)
            db.set_member("db_owner", e.identity.login, True)
        return QueryResult(message=f"Database '{st.name}' created.")

    def _use(self, st: s.Use) -> QueryResult:
        e = self.engine
        path = e._db_path(st.name)
        if path is None:
            if st.name.lower() in SYSTEM_DATABASES:
                return QueryResult(message=f"Database context is '{st.name}'.")
            raise SqlError(f"Database '{st.name}' does not exist.")
        if not e._may_use(path.name):
            raise PermissionDenied(f"The login does not have access to database '{path.name}'.")
        e.current = path.name
        return QueryResult(message=f"Changed database context to '{path.name}'.")

    def _createschema(self, st: s.CreateSchema) -> QueryResult:
        self.engine.identity.require(self.engine.security, "ALTER", st.name, "")
        self.engine.security.create_schema(st.name, st.owner)
        return QueryResult(message=f"Schema '{st.name}' created.")

    def _createtable(self, st: s.CreateTable) -> QueryResult:
        e = self.engine
        schema, name = st.name[-2] if len(st.name) > 1 else "dbo", st.name[-1]
        if e.security.schema(schema) is None:
            raise SqlError(f"Schema '{schema}' does not exist.")
        e.identity.require(e.security, "ALTER", schema, name)
        plain = [Column.of(c) for c in st.columns if not c.computed]
        probe = Scope([Source("", "p", [(c.name, kind_of_declared(c.type)) for c in plain])])
        fields = ", ".join(f"CAST(NULL AS {c.spark}) AS {ident(c.name)}" for c in plain)
        columns = []
        for c in st.columns:
            if c.computed:  # Catalyst gives its type
                sql, _ = self.lowering().value(parse_expression(c.computed), probe)
                columns.append(Column.of(c, self.spark.sql(f"SELECT {sql} AS v FROM (SELECT {fields}) AS p").schema[0].dataType.simpleString()))
            else:
                columns.append(Column.of(c))
        e.store.create(schema, name, columns)
        return QueryResult(message=f"Table '{name}' created.")

    # DML
    def _row_texts(self, columns: list[Column]) -> tuple[dict[str, str], dict[str, str]]:
        """Spark SQL of defaults and of computed columns, by column."""
        low = self.lowering()
        scope = Scope([Source("", "", [(c.name, kind_of_declared(c.type)) for c in columns if not c.computed])])
        scope.find = lambda name, find=scope.find: (lambda hit: (ident(name[-1]), hit[1]) if hit else None)(find(name[-1:]))  # type: ignore[method-assign]
        defaults = {c.name: low.value(parse_expression(c.default), Scope())[0] for c in columns if c.default}
        computed = {c.name: low.value(parse_expression(c.computed), scope)[0] for c in columns if c.computed}
        return defaults, computed

    def _insert(self, st: s.Insert) -> QueryResult:
        e = self.engine
        store, ref = e._ref(st.name, "INSERT")
        ref.guard()
        columns = ref.manifest.columns
        if st.columns is None:
            given = [c.name for c in columns if not c.identity and not c.computed]
        else:
            given = []
            for name in st.columns:
                c = next((c for c in columns if c.name.lower() == name.lower()), None)
                if c is None:
                    raise SqlError(f"Invalid column name '{name}'.")
                if c.computed:
                    raise SqlError(f"Column '{name}' is computed.")
                given.append(c.name)
        if st.rows is not None:
            low = self.lowering()
            texts = []
            by_name = {c.name: c for c in columns}
            for r in st.rows:
                dml.cast_check(len(r), len(given))
                texts.append([self._stored(low, low.value(v, Scope()), by_name[g]) for v, g in zip(r, given)])
            rows = dml.literal_rows(self.spark, texts)
        else:
            rows, names = self.frame(s.With(st.ctes, st.query) if st.ctes else st.query)
            dml.cast_check(len(names), len(given))
        defaults, computed = self._row_texts(columns)
        with LOCKS.hold(ref.path):
            ref = store.find(ref.schema, ref.name)
            scratch = store.tables / f".scratch-{uuid.uuid4().hex}"
            try:
                n = dml.append(store, ref, dml.completed(rows, given, columns, defaults, computed, ref.manifest.identity, str(scratch)))
            finally:
                scratch.remove_tree()
        return QueryResult(message=f"{n} row(s) inserted into [{ref.name}].")

    def _stored(self, low: Lowering, value: tuple[str, str], c: Column) -> str:
        sql, _ = low.cast(value, s.TypeName("int") if c.declared == "bit" else c.type)
        return f"CAST({sql} AS {c.spark})"

    def _update(self, st: s.Update) -> QueryResult:
        e = self.engine
        name, joins = st.target, list(st.sources)
        alias = st.target[-1]
        table = self._find_target(joins, st.target)
        if table is not None:
            name, alias = table.name, table.alias or table.name[-1]
        store, ref = e._ref(name, "UPDATE")
        ref.guard()
        e.identity.require(e.security, "SELECT", ref.schema, ref.name)
        columns = ref.manifest.columns
        sets = []
        for column, op, value in st.sets:
            c = next((c for c in columns if c.name.lower() == column.lower()), None)
            if c is None:
                raise SqlError(f"Invalid column name '{column}'.")
            if c.computed or c.identity:
                raise SqlError(f"Column '{column}' cannot be updated.")
            sets.append((c, value if op == "=" else s.Binary(op[0], s.Column((alias, c.name)), value)))
        _, computed = self._row_texts(columns)
        with LOCKS.hold(ref.path):
            ref = store.find(ref.schema, ref.name)
            if not ref.manifest.parts:
                return QueryResult(message=f"0 row(s) updated in [{ref.name}].")
            before = ref.read(self.spark)
            mark, files = dml.file_marks(before)
            target = before.select("*", dml.place(mark).alias("__row"))
            others = [x for x in self._tables_of(joins) if x.name != name]
            marks: dict[s.Name, dict] = {}

            def resolve(n: s.Name) -> DataFrame:
                if n == name:
                    return target
                df = e.resolve(n)
                if n not in ordered:
                    return df
                own, known = dml.file_marks(df)
                marks.setdefault(n, {}).update(known)
                return df.select("*", dml.place(own).alias("__at"))

            named = {c.name.lower() for c in st.ctes or []}
            ordered = {x.name for x in others if not (len(x.name) == 1 and x.name[0].lower() in named) and e.has_files(x.name)}
            source = joins or [s.Table(name, alias if alias != name[-1] else None)]
            items = [s.Item(s.Column((alias, "__row")), "__row")] + [s.Item(v, f"__set{i}") for i, (_, v) in enumerate(sets)]
            with_place = [x for x in others if x.name in ordered]
            order = [s.Item(s.Column((x.alias or x.name[-1], "__at")), f"__at{i}") for i, x in enumerate(with_place)]
            query = s.Select(items + order, source, st.where)
            low = self.lowering(resolve)
            texts = low.query(s.With(st.ctes, query) if st.ctes else query)
            kinds = [k for _, k in texts.columns[1 : 1 + len(sets)]]
            new = [F.expr(self._stored(low, (f"`__set{i}`", kinds[i]), c)).alias(f"__set{i}") for i, (c, _) in enumerate(sets)]
            found = self.spark.sql(texts.sql).where("__row IS NOT NULL").select(F.col("__row.file").alias("__file"), F.col("__row.index").alias("__index"), F.struct(*new).alias("__new"), *(x.alias for x in order))
            scratch, n = store.tables / f".scratch-{uuid.uuid4().hex}", 0
            try:
                found.write.option("maxRecordsPerFile", dml.SLICE_ROWS).parquet(str(scratch))  # the join runs once; nothing is gathered yet
                found = self.spark.read.schema(found.schema).parquet(str(scratch))
                matches = {r["file"]: r["n"] for r in found.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n")).collect()}  # a row for each file
                if matches:
                    hits = [files[m] for m in matches]
                    if joins not in ([], [table]):
                        found = dml.last_matches(found, [marks[x.name] for x in with_place])
                    if sum(matches.values()) > dml.FEW_MATCHES:
                        found = found.hint("merge")
                    at, seen = {c.name: i for i, (c, _) in enumerate(sets)}, Observation()
                    hit = F.col("__new").isNotNull()
                    joined = dml.rows_of(self.spark, ref, hits).select("*", mark.alias("__file"), F.col("_metadata.row_index").alias("__index")).join(found, ["__file", "__index"], "left").observe(seen, F.count_if(hit).alias("n"))
                    out = joined.select(*(F.when(hit, F.col(f"__new.__set{at[c.name]}")).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in at else F.col(f"`{c.name}`") for c in columns))
                    dml.replace(store, ref, hits, dml.with_computed(out, columns, computed))
                    n = seen.get["n"]
            finally:
                scratch.remove_tree()
        return QueryResult(message=f"{n} row(s) updated in [{ref.name}].")

    def _tables_of(self, sources: list) -> list[s.Table]:
        """The tables that are joined by name, from left to right."""
        out: list[s.Table] = []
        for x in sources:
            out += self._tables_of([x.left, x.right]) if isinstance(x, s.Join) else [x] if isinstance(x, s.Table) else []
        return out

    def _find_target(self, sources: list, target: s.Name) -> s.Table | None:
        for x in sources:
            if isinstance(x, s.Join):
                found = self._find_target([x.left, x.right], target)
                if found is not None:
                    return found
            elif isinstance(x, s.Table) and len(target) == 1 and (x.alias or "").lower() == target[0].lower():
                return x
        return next((x for x in sources if isinstance(x, s.Table) and x.name[-1].lower() == target[-1].lower()), None)

    def _delete(self, st: s.Delete) -> QueryResult:
        e = self.engine
        store, ref = e._ref(st.target, "DELETE")
        ref.guard()
        with LOCKS.hold(ref.path):
            ref = store.find(ref.schema, ref.name)
            if st.where is None:
                n = ref.read(self.spark).count()  # from the files' footers
                store.publish(ref, [], ref.manifest.identity)
                return QueryResult(message=f"{n} row(s) deleted from [{ref.name}].")
            if not ref.manifest.parts:
                return QueryResult(message=f"0 row(s) deleted from [{ref.name}].")
            alias = st.alias or st.target[-1]
            before = ref.read(self.spark).select("*", F.col("_metadata.file_path").alias("__file"))
            chosen: list[DataFrame] = [before]

            def resolve(n: s.Name) -> DataFrame:
                return chosen[0] if n == st.target else e.resolve(n)

            def text(query: s.Select) -> str:
                low = self.lowering(resolve)
                leaf = low._leaf
                low._leaf = lambda x, scope: (f"(({low.predicate(x.where, scope)}) IS NULL)", False) if isinstance(x, _Unknown) else leaf(x, scope)  # type: ignore[method-assign]
                return low.query(s.With(st.ctes, query) if st.ctes else query).sql

            source = [s.Table(st.target, st.alias)]
            gone = self.spark.sql(text(s.Select([s.Item(s.Column((alias, "__file")), "__file")], source, st.where)))
            hits = {r.file: r.n for r in gone.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n")).collect()}  # a row for each file
            if hits:  # the other files stay as they are
                chosen[0] = before.withColumn("__hit", F.col("__file").isin(list(hits)))
                stays = s.Logic("or", [s.Logic("not", [st.where]), _Unknown(st.where)])
                keep = s.Select([s.Item(s.Column((alias, c.name)), c.name) for c in ref.manifest.columns], source, s.Logic("and", [s.Compare("=", s.Column((alias, "__hit")), s.Literal("int", 1)), stays]))
                dml.replace(store, ref, hits, self.spark.sql(text(keep)))
        return QueryResult(message=f"{sum(hits.values())} row(s) deleted from [{ref.name}].")

    # procedures
    def _createprocedure(self, st: s.CreateProcedure) -> QueryResult:
        e = self.engine
        e.identity.require(e.security, "ALTER", st.name[-2] if len(st.name) > 1 else "dbo", st.name[-1])
        path = e._procedure_path(st.name)
        if st.mode == "create" and path.exists():
            raise SqlError(f"Procedure '{st.name[-1]}' already exists.")
        if st.mode == "alter" and not path.exists():
            raise SqlError(f"Procedure '{st.name[-1]}' does not exist.")
        head = st.text[: st.text.index(st.body)] if st.body else st.text
        params = head[head.find(st.name[-1]) + len(st.name[-1]) :].lstrip("]\" \n\t")
        definition = f"CREATE OR ALTER PROCEDURE {'.'.join(st.name)} {params}{st.body}"
        path.replace_text(json.dumps({"name": ".".join(st.name), "definition": definition, "changed": now_text()}))
        return QueryResult(message=f"Procedure '{st.name[-1]}' saved.")

    def _dropprocedure(self, st: s.DropProcedure) -> QueryResult:
        e = self.engine
        for name in st.names:
            e.identity.require(e.security, "ALTER", name[-2] if len(name) > 1 else "dbo", name[-1])
            path = e._procedure_path(name)
            if path.exists():
                path.unlink()
            elif not st.if_exists:
                raise SqlError(f"Procedure '{name[-1]}' does not exist.")
        return QueryResult(message="Command completed.")

    def _execute(self, st: s.Execute) -> QueryResult:
        e = self.engine
        e.identity.require(e.security, "EXECUTE", st.name[-2] if len(st.name) > 1 else "dbo", st.name[-1])
        path = e._procedure_path(st.name)
        if not path.exists():
            raise SqlError(f"Procedure '{st.name[-1]}' does not exist.")
        proc = parse_script(json.loads(path.read_text())["definition"])[0][0]
        named = [a for a in st.args if a[0]]
        if named and len(named) != len(st.args):
            raise SqlError("Arguments are given either by place or by name.")
        if len(st.args) > len(proc.params):
            raise SqlError(f"Procedure '{st.name[-1]}' takes {len(proc.params)} arguments.")
        known = {p.name.lower() for p in proc.params}
        for a in named:
            if a[0].lower() not in known:
                raise SqlError(f"Procedure '{st.name[-1]}' has no parameter {a[0]}.")
        inner = _Run(e, self.nesting + 1)
        outputs = []
        for i, p in enumerate(proc.params):
            arg = next((a for a in named if a[0].lower() == p.name.lower()), None) if named else st.args[i] if i < len(st.args) else None
            if arg is None and not p.has_default and not p.output:
                raise SqlError(f"Procedure '{st.name[-1]}' needs parameter {p.name}.")
            if arg is not None and arg[2]:
                if not p.output or not isinstance(arg[1], s.Variable):
                    raise SqlError(f"Parameter {p.name} cannot be passed as OUTPUT.")
                outputs.append((arg[1].name, p.name))
            low = self.lowering()
            value = arg[1] if arg is not None else p.default
            sql = low.cast(low.value(value, Scope()), p.type)[0] if value is not None else None
            inner.types[p.name.lower()] = p.type
            inner.variables[p.name.lower()] = inner.literal(self.spark.sql(f"SELECT {sql} AS v").first().v if sql else None, p.type)
        out = QueryResult(message="Command completed.")
        try:
            for x in (x for b in parse_script(proc.body) for x in b):
                now = inner.run(x)
                out = now if now.columns or not out.columns else out
        finally:
            for mine, theirs in outputs:
                if mine.lower() not in self.variables:
                    raise SqlError(f'Must declare the scalar variable "{mine}".')
                value = self.spark.sql(f"SELECT {inner.variables[theirs.lower()][0]} AS v").first().v
                self.variables[mine.lower()] = self.literal(value, self.types[mine.lower()])
        return out

    # security
    def _security(self, st: s.Security) -> QueryResult:
        getattr(self, f"_do_{st.action}")(**st.args)
        return QueryResult(message="Command completed.")

    def _server_admin(self) -> None:
        if not self.engine.identity.has_server_role("sysadmin", "securityadmin"):
            raise PermissionDenied("Permission denied: managing logins.")

    def _database_admin(self) -> DatabaseSecurity:
        e = self.engine
        db = e.security
        user = e.identity.user(db)
        if not e.identity.is_admin and not (user and db.manages(user)):
            raise PermissionDenied("Permission denied: managing the security of the database.")
        return db

    def _do_create_login(self, name: str, password: str) -> None:
        self._server_admin()
        self.engine.server.create_login(name, password)

    def _do_drop_login(self, name: str, if_exists: bool) -> None:
        self._server_admin()
        self.engine.server.drop_login(name, if_exists)

    def _do_create_user(self, name: str, login: str | None) -> None:
        db = self._database_admin()
        if login is not None and self.engine.server.find(login) is None:
            raise SqlError(f"Login '{login}' does not exist.")
        db.create_user(name, login)

    def _do_create_role(self, name: str, owner: str | None) -> None:
        self._database_admin().create_role(name, owner)

    def _do_alter_role(self, server: bool, role: str, add: bool, member: str) -> None:
        if server:
            self._server_admin()
            if role.lower() == "sysadmin" and not self.engine.identity.has_server_role("sysadmin"):
                raise PermissionDenied("Permission denied: only sysadmin members change sysadmin.")
            self.engine.server.set_member(role, member, add)
        else:
            self._database_admin().set_member(role, member, add)

    def _permission(self, state: str | None, permissions: list[str], kind: str | None, target: s.Name | None, grantees: list[str]) -> None:
        db = self._database_admin()
        if kind is None:
            raise SqlError("A securable target is required.")
        securable = "" if kind == "DATABASE" else target[-1] if kind == "SCHEMA" else f"{target[-2] if len(target) > 1 else 'dbo'}.{target[-1]}"
        if kind == "SCHEMA" and db.schema(securable) is None:
            raise SqlError(f"Schema '{securable}' does not exist.")
        for p in permissions:
            for g in grantees:
                db.set_permission(state, p, kind, securable, g)

    def _do_grant(self, **args) -> None:
        self._permission("GRANT", **args)

    def _do_deny(self, **args) -> None:
        self._permission("DENY", **args)

    def _do_revoke(self, **args) -> None:
        self._permission(None, **args)

    def _do_execute_as(self, name: str) -> None:
        self._database_admin()
        self.engine.security.require(name)
        self.engine.identity.acting.append(name)

    def _do_revert(self) -> None:
        if self.engine.identity.acting:
            self.engine.identity.acting.pop()


@dataclass
class _Unknown:
    """A predicate that is neither true nor false."""

    where: Any
