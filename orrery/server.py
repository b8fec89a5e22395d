"""A small REST service over the engine, with the standard library's HTTP server.

POST /api/login {login, password} -> {token}; the token goes in the header Authorization: Bearer.
POST /api/logout, GET /api/me, GET /api/databases, GET /api/databases/D/permissions, GET /api/server/logins,
GET /api/server/roles, GET /api/databases/D/tables, GET /api/databases/D/tables/T (facts),
GET /api/databases/D/tables/T/stream?offset&limit&batch (NDJSON), GET /api/databases/D/procedures[/P],
POST /api/databases/D/access {login, roles}, POST /api/sql {database, sql}. schema is a query parameter.
"""

from __future__ import annotations

import json
import secrets
import threading
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import PermissionDenied, SqlError


class Service:
    """Sessions by token. A request runs in an engine of its own, as the token's login."""

    def __init__(self, spark: SparkSession, data_root: str) -> None:
        self.spark, self.root = spark, data_root
        self.tokens: dict[str, str] = {}
        self._guard = threading.Lock()

    def login(self, name: str, password: str) -> str | None:
        if not Engine(self.spark, self.root).login(name, password):
            return None
        token = secrets.token_urlsafe(32)
        with self._guard:
            self.tokens[token] = name
        return token

    def logout(self, token: str) -> None:
        with self._guard:
            self.tokens.pop(token, None)

    def engine(self, token: str) -> Engine | None:
        name = self.tokens.get(token)
        if name is None:
            return None
        e = Engine(self.spark, self.root)
        e.resume_login(name)
        return e

    def get(self, e: Engine, path: list[str], query: dict[str, str]):
        schema = query.get("schema", "dbo")
        match path:
            case ["me"]:
                return {"login": e.identity.login, "databases": e.list_accessible_databases()}
            case ["databases"]:
                return e.list_accessible_databases()
            case ["databases", d, "permissions"]:
                return e.get_my_permissions(d)
            case ["server", "logins"]:
                self._admin(e)
                return e.list_server_logins()
            case ["server", "roles"]:
                self._admin(e)
                return e.list_server_roles()
            case ["databases", d, "tables"]:
                return self._rows(e, d, "SELECT name FROM sys.tables ORDER BY name")
            case ["databases", d, "tables", t]:
                return asdict(e.get_table_info(t, schema, d))
            case ["databases", d, "procedures"]:
                return self._rows(e, d, "SELECT name FROM sys.procedures ORDER BY name")
            case ["databases", d, "procedures", p]:
                if not e.can_view_object(d, p, schema):
                    raise PermissionDenied("Permission denied: VIEW DEFINITION.")
                return {"definition": e.get_procedure_definition(d, p, schema)}
        return None

    def post(self, e: Engine, path: list[str], body: dict):
        match path:
            case ["sql"]:
                if body.get("database"):
                    used = e.execute_query(f"USE [{str(body['database']).replace(']', ']]')}]")
                    if not used.success:
                        return {"success": False, "message": used.message, "columns": [], "rows": []}
                results = e.execute_script(str(body.get("sql", "")))
                last = next((r for r in reversed(results) if r.columns), None)
                return {"success": all(r.success for r in results), "message": "\n".join(r.message for r in results if r.message), "columns": last.columns if last else [], "rows": last.rows if last else []}
            case ["databases", d, "access"]:
                e.grant_database_access(d, body["login"], body.get("roles") or [])
                return {"success": True}
        return None

    def _admin(self, e: Engine) -> None:
        if not e.identity.has_server_role("sysadmin", "securityadmin"):
            raise PermissionDenied("Permission denied: server principals.")

    def _rows(self, e: Engine, database: str, sql: str) -> list[str]:
        r = e.execute_query(f"USE [{database.replace(']', ']]')}]; {sql}")
        if not r.success:
            raise SqlError(r.message)
        return [x["name"] for x in r.rows]


def make_server(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _say(self, status: int, value) -> None:
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _handle(self, verb: str) -> None:
            url = urlsplit(self.path)
            parts = [unquote(p) for p in url.path.split("/") if p]
            query = {k: v[0] for k, v in parse_qs(url.query).items()}
            token = (self.headers.get("Authorization") or "").removeprefix("Bearer ")
            if parts[:1] != ["api"]:
                return self._say(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}") if verb == "POST" else {}
                if verb == "POST" and parts[1:] == ["login"]:
                    made = service.login(str(body.get("login", "")), str(body.get("password", "")))
                    return self._say(200, {"token": made}) if made else self._say(401, {"error": "login failed"})
                engine = service.engine(token)
                if engine is None:
                    return self._say(401, {"error": "not logged in"})
                if verb == "POST" and parts[1:] == ["logout"]:
                    service.logout(token)
                    return self._say(200, {})
                match parts[1:]:
                    case ["databases", d, "tables", t, "stream"]:
                        return self._stream(engine, d, t, query)
                found = service.get(engine, parts[1:], query) if verb == "GET" else service.post(engine, parts[1:], body)
                return self._say(404, {"error": "not found"}) if found is None else self._say(200, found)
            except PermissionDenied as e:
                return self._say(403, {"error": str(e)})
            except (SqlError, ValueError, KeyError) as e:
                return self._say(400, {"error": str(e)})

        def _stream(self, engine: Engine, database: str, table: str, query: dict[str, str]) -> None:
            number = lambda k: int(query[k]) if k in query else None
            stream = engine.open_table_stream(database, table, query.get("schema", "dbo"), number("batch") or 10_000, number("offset") or 0, number("limit"))
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            for line in stream.ndjson():
                self.wfile.write(line.encode() + b"\n")
                self.wfile.flush()

        def do_GET(self) -> None:
            self._handle("GET")

        def do_POST(self) -> None:
            self._handle("POST")

    return ThreadingHTTPServer((host, port), Handler)
