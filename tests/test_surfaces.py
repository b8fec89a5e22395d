import json
import threading
import urllib.error
import urllib.request

import pytest

from orrery.repl import loop
from orrery.server import Service, make_server


def test_repl(engine, tmp_path):
    (tmp_path / "s.sql").write_text("SELECT 41 + 1 AS answer")
    lines = iter(["SELECT 1 AS", "one;", "SELECT 'a' AS x", "GO", f":r {tmp_path / 's.sql'}", "run nowhere.sql", "SELEC;", "quit"])
    said = []
    loop(engine, lambda prompt: next(lines), said.append)
    text = "\n".join(said)
    assert "(1 row(s) returned)" in text and "42" in text and "Parse error" in text and "nowhere.sql" in text


@pytest.fixture
def service(spark, engine, rows):
    engine.initialize_server("pw")
    rows("CREATE TABLE t (A INT); INSERT INTO t VALUES (1), (2), (3); CREATE LOGIN ann WITH PASSWORD = 'a'; CREATE PROCEDURE p AS SELECT 1 AS one")
    server = make_server(Service(spark, str(engine.root)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, token=None):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(r, timeout=60) as f:
                return f.status, f.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    yield ask
    server.shutdown()


def test_rest(service):
    assert service("databases")[0] == 401 and service("login", {"login": "sa", "password": "no"})[0] == 401
    sa = json.loads(service("login", {"login": "sa", "password": "pw"})[1])["token"]
    ann = json.loads(service("login", {"login": "ann", "password": "a"})[1])["token"]
    assert json.loads(service("databases", token=sa)[1]) == ["lab"] and json.loads(service("databases", token=ann)[1]) == []
    assert json.loads(service("sql", {"database": "lab", "sql": "SELECT SUM(A) AS s FROM t"}, sa)[1])["rows"] == [{"s": 6}]
    assert not json.loads(service("sql", {"database": "lab", "sql": "SELECT 1"}, ann)[1])["success"]
    assert service("databases/lab/access", {"login": "ann", "roles": ["db_datareader"]}, ann)[0] == 403
    assert service("databases/lab/access", {"login": "ann", "roles": ["db_datareader"]}, sa)[0] == 200
    assert json.loads(service("databases/lab/tables", token=ann)[1]) == ["t"]
    lines = [json.loads(x) for x in service("databases/lab/tables/t/stream?offset=1&limit=2", token=ann)[1].splitlines()]
    assert lines[0]["totalRows"] == 3 and [r["A"] for r in lines[1]["rows"]] == [2, 3]
    assert json.loads(service("databases/lab/tables/t", token=ann)[1])["row_count"] == 3
    assert "SELECT 1" in json.loads(service("databases/lab/procedures/p", token=sa)[1])["definition"]
    assert service("server/logins", token=ann)[0] == 403 and service("nothing", token=ann)[0] == 404
    service("logout", {}, ann)
    assert service("me", token=ann)[0] == 401
