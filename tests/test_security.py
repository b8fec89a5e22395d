import pytest

from orrery.engine import Engine


@pytest.fixture
def world(engine, rows):
    assert engine.initialize_server("secret") and not engine.initialize_server("other")
    rows("CREATE LOGIN ann WITH PASSWORD = 'a'; CREATE LOGIN bob WITH PASSWORD = 'b'; CREATE USER ann FOR LOGIN ann; CREATE TABLE t (A INT); INSERT INTO t VALUES (1); CREATE SCHEMA sales; CREATE TABLE sales.o (A INT)")

    def session(name, password):
        e = Engine(engine.spark, engine.root)
        assert e.login(name, password)
        return e

    return session


def say(e, sql):
    r = e.execute_script("USE lab; " + sql)[-1]
    return "ok" if r.success else r.message


def test_logins(world, engine, fails):
    assert not Engine(engine.spark, engine.root).login("ann", "wrong")
    assert "does not exist" in fails("DROP LOGIN nobody")
    assert "does not have access" in say(world("bob", "b"), "SELECT 1")
    assert engine.list_server_logins()[0] == {"name": "sa", "disabled": False, "is_sysadmin": True}
    assert world("sa", "secret").list_accessible_databases() == ["lab"] and world("bob", "b").list_accessible_databases() == []


def test_grant_deny_revoke(world, rows, fails):
    ann = world("ann", "a")
    assert "Permission denied" in say(ann, "SELECT * FROM t")
    rows("GRANT SELECT ON t TO ann")
    assert say(ann, "SELECT * FROM t") == "ok" and "Permission denied" in say(ann, "INSERT INTO t VALUES (2)")
    rows("DENY SELECT ON DATABASE::lab TO ann")
    assert "Permission denied" in say(ann, "SELECT * FROM t")
    rows("REVOKE SELECT ON DATABASE::lab FROM ann")
    assert say(ann, "SELECT * FROM t") == "ok"
    assert "securable target" in fails("GRANT SELECT TO ann")
    assert "Permission denied" in say(ann, "GRANT SELECT ON t TO ann")


def test_every_table_of_a_query_is_checked(world, rows):
    ann = world("ann", "a")
    rows("GRANT SELECT ON SCHEMA::sales TO ann")
    assert say(ann, "SELECT * FROM sales.o") == "ok"
    for sql in ("SELECT (SELECT COUNT(*) FROM t) AS n FROM sales.o", "WITH c AS (SELECT * FROM t) SELECT 1 AS x FROM c", "SELECT 1 AS x FROM sales.o WHERE A IN (SELECT A FROM t)"):
        assert "Permission denied" in say(ann, sql)


def test_roles_ownership_and_fixed_roles(world, rows):
    ann = world("ann", "a")
    rows("CREATE ROLE crew; ALTER ROLE crew ADD MEMBER ann; GRANT SELECT ON t TO crew")
    assert say(ann, "SELECT * FROM t") == "ok"
    rows("ALTER ROLE crew DROP MEMBER ann; ALTER ROLE db_datawriter ADD MEMBER ann")
    assert "Permission denied" in say(ann, "SELECT * FROM t") and say(ann, "INSERT INTO t VALUES (5)") == "ok"
    rows("CREATE SCHEMA own AUTHORIZATION ann; DENY SELECT ON DATABASE::lab TO ann")
    assert say(ann, "CREATE TABLE own.x (A INT)") == "ok" and say(ann, "SELECT * FROM own.x") == "ok"


def test_visibility_and_impersonation(world, engine, rows):
    ann = world("ann", "a")
    assert ann.execute_query("USE lab; SELECT name FROM sys.tables").rows == []
    rows("GRANT SELECT ON t TO ann")
    assert ann.execute_query("SELECT name FROM sys.tables").rows == [{"name": "t"}]
    assert not ann.can_read_table("lab", "o", "sales") and ann.can_read_table("lab", "t")
    assert "Permission denied" in engine.execute_script("EXECUTE AS USER = 'ann'; SELECT * FROM sales.o")[-1].message
    assert engine.execute_script("REVERT; SELECT * FROM sales.o")[-1].success


def test_database_creation_needs_a_role(world, engine, rows):
    ann = world("ann", "a")
    assert "does not have permission to create databases" in ann.execute_query("CREATE DATABASE mine").message
    rows("ALTER SERVER ROLE dbcreator ADD MEMBER ann")
    assert ann.execute_query("CREATE DATABASE mine; USE mine; CREATE TABLE t (A INT)").success
    assert ann.list_accessible_databases() == ["lab", "mine"]


def test_procedures_need_execute(world, rows):
    ann = world("ann", "a")
    rows("CREATE PROCEDURE p AS SELECT 1 AS one")
    assert "Permission denied" in say(ann, "EXEC p")
    rows("GRANT EXECUTE ON p TO ann")
    assert say(ann, "EXEC p") == "ok"
