import threading

from orrery.engine import Engine


def test_identity_default_and_computed(rows):
    rows("CREATE TABLE t (Id INT IDENTITY(10,5), N INT NOT NULL, Note VARCHAR(10) DEFAULT 'x', Twice AS N * 2)")
    rows("INSERT INTO t (N) VALUES (1), (2); INSERT INTO t (N, Note) SELECT N + 10, NULL FROM t")
    assert rows("SELECT Id, N, Note, Twice FROM t ORDER BY Id") == [(10, 1, "x", 2), (15, 2, "x", 4), (20, 11, None, 22), (25, 12, None, 24)]


def test_column_counts_and_names(rows, fails):
    rows("CREATE TABLE t (A INT, B INT)")
    assert "does not match" in fails("INSERT INTO t VALUES (1)")
    assert "does not match" in fails("INSERT INTO t (A) SELECT 1, 2")
    assert "Invalid column" in fails("INSERT INTO t (C) VALUES (1)")
    rows("INSERT INTO t (b, a) VALUES (1, 2)")
    assert rows("SELECT A, B FROM t") == [(2, 1)]


def test_update_forms(rows):
    rows("CREATE TABLE t (K INT, V INT, W AS V + 1); INSERT INTO t VALUES (1, 10), (1, 10), (2, 20), (3, NULL)")
    rows("UPDATE t SET V += 5 WHERE K = 1")
    assert rows("SELECT K, V, W FROM t ORDER BY K, V") == [(1, 15, 16), (1, 15, 16), (2, 20, 21), (3, None, None)]
    rows("CREATE TABLE u (K INT, V INT); INSERT INTO u VALUES (2, 7), (2, 9), (5, 1)")
    r = rows("UPDATE x SET x.V = u.V FROM t x JOIN u ON u.K = x.K; SELECT V FROM t WHERE K = 2")
    assert r == [(9,)]  # the last match
    rows("WITH c AS (SELECT MAX(V) AS m FROM u) UPDATE t SET V = c.m FROM t, c WHERE t.K = 3")
    assert rows("SELECT V FROM t WHERE K = 3") == [(9,)]


def test_delete_keeps_what_is_unknown(rows):
    rows("CREATE TABLE t (K INT); INSERT INTO t VALUES (1), (2), (NULL)")
    rows("DELETE FROM t WHERE K = 1")
    assert rows("SELECT K FROM t ORDER BY K") == [(None,), (2,)]
    rows("DELETE FROM t")
    assert rows("SELECT COUNT(*) FROM t") == [(0,)]


def test_ddl_errors(rows, fails):
    rows("CREATE TABLE t (A INT)")
    assert "already exists" in fails("CREATE TABLE t (A INT)")
    assert "Schema 'nope' does not exist" in fails("CREATE TABLE nope.t (A INT)")
    assert "Unsupported data type" in fails("CREATE TABLE u (A XML)")
    rows("CREATE SCHEMA s; CREATE TABLE s.t (A INT); INSERT INTO s.t VALUES (5)")
    assert rows("SELECT A FROM s.t") == [(5,)] and rows("SELECT A FROM t") == []
    assert rows("SELECT A FROM lab.s.t") == [(5,)]


def test_rows_survive_a_new_engine(engine, rows):
    rows("CREATE TABLE t (A INT, D DATE, M MONEY, S NVARCHAR(9)); INSERT INTO t VALUES (1, '2025-06-15', 75000, 'é')")
    again = Engine(engine.spark, engine.root)
    out = rows("USE lab; SELECT A, YEAR(D), M, S FROM t", again)
    assert out[0][0] == 1 and out[0][1] == 2025 and float(out[0][2]) == 75000 and out[0][3] == "é"


def test_writers_do_not_share_identities(engine, rows):
    rows("CREATE TABLE c (Id INT IDENTITY(1,1), V INT)")
    errors = []

    def write(k):
        e = Engine(engine.spark, engine.root)
        for i in range(3):
            for r in e.execute_script(f"USE lab; INSERT INTO c (V) VALUES ({k * 10 + i})"):
                if not r.success:
                    errors.append(r.message)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert rows("SELECT COUNT(*), COUNT(DISTINCT Id), MIN(Id), MAX(Id), COUNT(DISTINCT V) FROM c") == [(12, 12, 1, 12, 12)]


def test_readings_of_three_gauges(rows):
    """Rows made from a cross join, summed up into another table, and cut: checked against the same in Python."""
    rows("CREATE TABLE gauge (No INT IDENTITY(7, 7), Place NVARCHAR(20), Worst DECIMAL(9,2)); INSERT INTO gauge (Place) VALUES ('pier'), ('lock'), ('mouth')")
    rows("CREATE TABLE reading (Gauge INT, Slot INT, Height DECIMAL(9,2), Excess AS CASE WHEN Height > 4 THEN Height - 4 ELSE 0 END)")
    rows("INSERT INTO reading (Gauge, Slot, Height) SELECT g.No, k.object_id, (k.object_id * g.No) % 11 FROM gauge g CROSS JOIN sys.all_objects k WHERE k.object_id <= 700 AND (g.Place <> 'lock' OR k.object_id % 11 < 4)")
    made = [(no, slot, slot * no % 11) for no, place in ((7, "pier"), (14, "lock"), (21, "mouth")) for slot in range(1, 701) if place != "lock" or slot % 11 < 4]
    rows("UPDATE g SET g.Worst = m.h FROM gauge g JOIN (SELECT Gauge, MAX(Height) AS h FROM reading GROUP BY Gauge) m ON m.Gauge = g.No")
    assert [(no, float(worst)) for no, worst in rows("SELECT No, Worst FROM gauge ORDER BY No")] == [(no, max(h for g, _, h in made if g == no)) for no in (7, 14, 21)]
    rows("DELETE FROM reading WHERE Height < 3")
    n, excess = rows("SELECT COUNT(*), SUM(Excess) FROM reading")[0]
    left = [h for _, _, h in made if h >= 3]
    assert (n, float(excess)) == (len(left), sum(max(0, h - 4) for h in left))


def test_the_last_of_several_matches(rows):
    """In the order in which the joined table was written, whatever the values are."""
    rows("CREATE TABLE t (K INT, V INT); INSERT INTO t VALUES (1, 0), (2, 0), (3, 0); CREATE TABLE u (K INT, V INT); INSERT INTO u VALUES (1, 9), (1, 2); INSERT INTO u VALUES (2, 4); INSERT INTO u VALUES (2, 1), (1, NULL)")
    rows("UPDATE t SET V = u.V FROM t JOIN u ON u.K = t.K")
    assert rows("SELECT K, V FROM t ORDER BY K") == [(1, None), (2, 1), (3, 0)]


def test_changes_rewrite_the_files_with_hits_only(engine, rows):
    rows("CREATE TABLE t (K INT, V INT)")
    for k in range(4):
        rows(f"INSERT INTO t VALUES ({k}, 1), ({k}, 2)")
    before = engine.store.find("dbo", "t").files()
    rows("UPDATE t SET V = 5 WHERE K = 2 AND V = 2")
    now = engine.store.find("dbo", "t").files()
    assert len(set(before) - set(now)) == 1 and len(before) == len(now)
    rows("DELETE FROM t WHERE K = 0 OR V = 5")
    last = engine.store.find("dbo", "t").files()
    assert len(set(now) & set(last)) == 2 and rows("SELECT K, V FROM t ORDER BY K, V") == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]
    rows("DELETE FROM t WHERE K = 77; UPDATE t SET V = 0 WHERE K = 77")
    assert engine.store.find("dbo", "t").files() == last


def test_a_version_is_written_once(engine, rows, fails):
    """Two sessions that read the same version, as in two processes: one of them is told."""
    import pytest

    from orrery.errors import SqlError

    rows("CREATE TABLE t (K INT); INSERT INTO t VALUES (1)")
    store = engine.store
    mine, theirs = store.find("dbo", "t"), store.find("dbo", "t")
    store.publish(mine, [], None)
    with pytest.raises(SqlError, match="another session"):
        store.publish(theirs, mine.manifest.parts, None)
    assert rows("SELECT COUNT(*) FROM t") == [(0,)]


def peak_mb(spark, job):
    """MB of execution memory of a task while job runs: the mean of a stage's tasks, where it is largest."""
    import time

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(0.3)
        none = spark._jvm.java.util.ArrayList()
        found = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    known = stages()
    job()
    return max(x.peakExecutionMemory() / max(1, x.numCompleteTasks()) for k, x in stages().items() if k not in known) / 1e6


def many_rows(engine, rows, n):
    """A table t of n rows in one file."""
    engine.spark.range(n, numPartitions=1).write.parquet(str(engine.store.tables / "numbers"))
    rows("CREATE TABLE t (K BIGINT, V BIGINT); INSERT INTO t SELECT id, 0 FROM numbers")


def test_memory_of_an_update_with_several_matches(engine, rows):
    """Matches are gathered in slices and hold no path; they are not sent to all tasks because their file is small."""
    many_rows(engine, rows, 600_000)
    rows("CREATE TABLE u (K INT, V INT); INSERT INTO u VALUES (0, 9), (0, 2), (1, 7); INSERT INTO u VALUES (1, 3), (0, 5)")
    assert peak_mb(engine.spark, lambda: rows("UPDATE t SET V = u.V FROM t JOIN u ON u.K = t.K % 3")) < 150
    assert rows("SELECT K % 3 AS r, V, COUNT(*) FROM t GROUP BY K % 3, V ORDER BY r") == [(0, 5, 200_000), (1, 3, 200_000), (2, 0, 200_000)]


def test_update_leaves_out_rows_without_a_target(rows):
    rows("CREATE TABLE t (K INT, V INT); INSERT INTO t VALUES (1, 0), (2, 0); CREATE TABLE u (K INT, V INT); INSERT INTO u VALUES (1, 4), (3, 5), (3, 6)")
    rows("UPDATE x SET x.V = u.V FROM u LEFT JOIN t x ON x.K = u.K")
    assert rows("SELECT K, V FROM t ORDER BY K") == [(1, 4), (2, 0)]


def test_update_counts_rows_and_not_matches(engine, rows):
    rows("CREATE TABLE t (K INT, V INT); INSERT INTO t VALUES (1, 0), (2, 0), (3, 0); CREATE TABLE u (K INT, V INT); INSERT INTO u VALUES (1, 4), (1, 5), (2, 6); CREATE TABLE w (V INT); INSERT INTO w VALUES (10), (30); INSERT INTO w VALUES (20)")
    assert engine.execute_query("UPDATE t SET V = u.V + w.V FROM t JOIN u ON u.K = t.K CROSS JOIN w").message.startswith("2 row(s) updated")
    assert rows("SELECT K, V FROM t ORDER BY K") == [(1, 25), (2, 26), (3, 0)]


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    from orrery.operators import dml

    for folder in ("a b", "c"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / folder))
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / folder / "part %1.parquet")
        [x.unlink() for x in (tmp_path / folder).glob(".*.crc")]
    for names, n in ((["a b"], 1), (["a b", "c"], 2)):
        df = spark.read.parquet(*(str(tmp_path / x) for x in names))
        mark, files = dml.file_marks(df)
        assert len(files) == n and {r.m for r in df.select(mark.alias("m")).collect()} == set(files)


def test_memory_of_an_update_from_a_large_table(engine, rows):
    """What a join sends to all tasks holds no path; an update of a table alone gathers no matches."""
    many_rows(engine, rows, 600_000)
    rows("CREATE TABLE u (K BIGINT, V BIGINT); INSERT INTO u SELECT id, id % 5 FROM numbers")
    assert peak_mb(engine.spark, lambda: rows("UPDATE t SET V = u.V FROM t JOIN u ON u.K = t.K WHERE u.V > 1")) < 110
    assert peak_mb(engine.spark, lambda: rows("UPDATE t SET V += 1 WHERE V > 0")) < 110
    assert rows("SELECT V, COUNT(*) FROM t GROUP BY V ORDER BY V") == [(0, 240_000), (3, 120_000), (4, 120_000), (5, 120_000)]
