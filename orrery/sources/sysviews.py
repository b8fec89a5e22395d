"""The sys.* catalog views, as small local tables of what the session may see."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

EMPTY = "object_id INT, name STRING, schema_id INT, parent_object_id INT, type STRING, type_desc STRING, create_date TIMESTAMP_NTZ, modify_date TIMESTAMP_NTZ, is_ms_shipped INT, is_disabled INT"

# Views that exist and have no rows.
EMPTY_VIEWS = {
    "indexes", "index_columns", "foreign_keys", "foreign_key_columns", "key_constraints", "check_constraints", "default_constraints", "triggers", "synonyms",
    "sequences", "partitions", "allocation_units", "extended_properties", "computed_columns", "identity_columns", "sql_modules", "parameters", "assemblies",
}


def object_id(name: str) -> int:
    """A positive id, the same for a name in any letter case."""
    return zlib.crc32(name.lower().encode()) % 2_000_000_000 + 1000


def generator(spark: SparkSession) -> DataFrame:
    return spark.range(1, 2001).selectExpr("CAST(id AS INT) AS object_id", "concat('object_', id) AS name", "'U' AS type")


def view(spark: SparkSession, name: str, session) -> DataFrame | None:
    """session: an Engine. None for a name that is no view."""
    name = name.lower()
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    if name in ("all_objects", "objects_generator"):
        return generator(spark)
    if name == "databases":
        rows = [(d, 5 + i, session.database_created(d), 0, "ONLINE", 160, "SQL_Latin1_General_CP1_CI_AS", 0, "MULTI_USER") for i, d in enumerate(session.list_accessible_databases())]
        return make(rows, "name STRING, database_id INT, create_date TIMESTAMP_NTZ, state INT, state_desc STRING, compatibility_level INT, collation_name STRING, user_access INT, user_access_desc STRING")
    if name in EMPTY_VIEWS:
        return make([], EMPTY)
    if name == "types":
        rows = [("int", 56, 4), ("decimal", 106, 17), ("datetime", 61, 8), ("nvarchar", 231, 8000), ("bit", 104, 1), ("bigint", 127, 8)]
        return make([(n, i, i, 4, m) for n, i, m in rows], "name STRING, system_type_id INT, user_type_id INT, schema_id INT, max_length INT")
    if name in ("objects", "tables", "columns", "all_columns", "views", "all_views", "procedures", "schemas", "server_principals", "database_principals", "database_role_members", "database_permissions"):
        return getattr(_Views(spark, session), name.removeprefix("all_"))()
    return None


class _Views:
    def __init__(self, spark: SparkSession, session) -> None:
        self.spark, self.session = spark, session

    def _schema_id(self, schema: str) -> int:
        names = [s["name"].lower() for s in self.session.security.schemas()]
        return names.index(schema.lower()) + 1 if schema.lower() in names else 1

    def _tables(self) -> list[tuple[str, str]]:
        return [(s, t) for s, t in self.session.store.list() if self.session.can_view_object(self.session.database, t, s)]

    def objects(self) -> DataFrame:
        rows = [(object_id(t if s == "dbo" else f"{s}.{t}"), t, self._schema_id(s), "U") for s, t in self._tables()]
        rows += [(object_id(p), p, 1, "P") for p in self.session.procedure_names()]
        return self.spark.createDataFrame(rows, "object_id INT, name STRING, schema_id INT, type STRING")

    def tables(self) -> DataFrame:
        rows = [(t, object_id(t if s == "dbo" else f"{s}.{t}"), self._schema_id(s), 0, "U", "USER_TABLE", 0) for s, t in self._tables()]
        return self.spark.createDataFrame(rows, "name STRING, object_id INT, schema_id INT, parent_object_id INT, type STRING, type_desc STRING, is_ms_shipped INT")

    def views(self) -> DataFrame:
        return self.spark.createDataFrame([], "name STRING, object_id INT, schema_id INT, type STRING")

    def columns(self) -> DataFrame:
        rows = []
        for s, t in self._tables():
            for i, c in enumerate(self.session.table_columns(s, t)):
                rows.append((object_id(t if s == "dbo" else f"{s}.{t}"), c.name, i + 1, c.declared, int(c.nullable), int(bool(c.identity)), int(bool(c.computed)), (c.args or [0])[0], (c.args or [0, 0])[1] if len(c.args) > 1 else 0))
        return self.spark.createDataFrame(rows, "object_id INT, name STRING, column_id INT, type_name STRING, is_nullable INT, is_identity INT, is_computed INT, precision INT, scale INT")

    def procedures(self) -> DataFrame:
        return self.spark.createDataFrame([(p, object_id(p), "P") for p in self.session.procedure_names()], "name STRING, object_id INT, type STRING")

    def schemas(self) -> DataFrame:
        return self.spark.createDataFrame([(s["name"], i + 1, s["owner"]) for i, s in enumerate(self.session.security.schemas())], "name STRING, schema_id INT, owner STRING")

    def server_principals(self) -> DataFrame:
        from ..security import SERVER_ROLES

        rows = [(x["name"], "S", "SQL_LOGIN", int(x["disabled"])) for x in self.session.server.logins()] + [(r, "R", "SERVER_ROLE", 0) for r in SERVER_ROLES]
        return self.spark.createDataFrame(rows, "name STRING, type STRING, type_desc STRING, is_disabled INT")

    def database_principals(self) -> DataFrame:
        from ..security import PUBLIC, ROLE_ACTIONS

        state = self.session.security.state()
        rows = [(u["name"], "S", "SQL_USER", 0) for u in state["users"]] + [(r["name"], "R", "DATABASE_ROLE", 0) for r in state["roles"]] + [(r, "R", "DATABASE_ROLE", int(r != PUBLIC)) for r in (*ROLE_ACTIONS, PUBLIC)]
        return self.spark.createDataFrame(rows, "name STRING, type STRING, type_desc STRING, is_fixed_role INT")

    def database_role_members(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(m) for m in self.session.security.state()["members"]], "role_name STRING, member_name STRING")

    def database_permissions(self) -> DataFrame:
        rows = [(p["grantee"], p["permission"], p["class"], p["securable"], p["state"]) for p in self.session.security.state()["permissions"]]
        return self.spark.createDataFrame(rows, "grantee STRING, permission_name STRING, class_desc STRING, securable STRING, state_desc STRING")
