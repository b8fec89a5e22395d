def test_parameters_defaults_and_results(rows, fails):
    rows("CREATE TABLE t (A INT, B VARCHAR(9)); CREATE PROCEDURE put @a INT, @b VARCHAR(9) = 'none' AS BEGIN INSERT INTO t VALUES (@a, @b); SELECT A, B FROM t WHERE A = @a END")
    assert rows("EXEC put 1") == [(1, "none")]
    assert rows("EXEC put @b = 'x', @a = 2") == [(2, "x")]
    assert "needs parameter" in fails("EXEC put")
    assert "by place or by name" in fails("EXEC put 1, @b = 'x'")
    assert "has no parameter" in fails("EXEC put @z = 1")


def test_output_and_variables(rows, fails):
    rows("CREATE PROC half @x INT, @y INT OUTPUT AS SET @y = @x / 2")
    assert rows("DECLARE @r INT; EXEC half 9, @r OUTPUT; SELECT @r + 1") == [(5,)]
    assert "Must declare" in fails("SELECT @nope")
    assert rows("DECLARE @a INT = 2, @b DECIMAL(9,2) = 1.5, @s VARCHAR(9) = 'q'\nGO\nSET @a = @a * 3; SELECT @a, @s + '!', TRIM(' z ')") == [(6, "q!", "z")]
    assert rows("DECLARE @n INT = 2; SELECT TOP (@n) object_id FROM sys.all_objects ORDER BY object_id") == [(1,), (2,)]


def test_create_alter_drop(engine, rows, fails):
    rows("CREATE PROCEDURE p AS SELECT 1 AS one")
    assert "already exists" in fails("CREATE PROCEDURE p AS SELECT 2")
    rows("CREATE OR ALTER PROCEDURE p AS SELECT 2 AS two")
    assert rows("EXEC p") == [(2,)]
    assert "CREATE OR ALTER PROCEDURE p" in engine.get_procedure_definition("lab", "p")
    assert rows("SELECT name FROM sys.procedures") == [("p",)]
    rows("DROP PROCEDURE p; DROP PROCEDURE IF EXISTS p")
    assert "does not exist" in fails("EXEC p")
    assert "does not exist" in fails("ALTER PROCEDURE p AS SELECT 1")


def test_scripts_stop_or_go_on(engine, tmp_path):
    script = tmp_path / "s.sql"
    script.write_text("SELECT 1 AS a\nGO\nSELECT 1/0 AS b\nGO\nSELECT 3 AS c\n")
    assert [r.success for r in engine.execute_script_file(script)] == [True, False]
    assert [r.success for r in engine.execute_script_file(script, continue_on_error=True)] == [True, False, True]
    assert engine.execute_query("SELECT 1 AS a; SET NOCOUNT ON; SELECT 2 AS b").rows == [{"b": 2}]
