"""Queries through the engine on a small star catalogue: ties in magnitude, nulls in every column that can hold them, references to nothing."""

import pytest

SETUP = """
CREATE TABLE Star (No INT, Label NVARCHAR(40), Mag DECIMAL(6,2), Pair INT);
INSERT INTO Star VALUES (11, 'Mira', 6.5, NULL), (12, 'Algol', 2.1, 11), (13, 'Castor', 2.1, 11), (14, NULL, 4.0, 12), (15, 'Rana', NULL, 12);
CREATE TABLE Look (StarNo INT, Site NVARCHAR(40), Night DATE);
INSERT INTO Look VALUES (11, 'ridge', '2024-03-01'), (11, 'coast', '2024-03-02'), (13, 'ridge', '2024-03-02'), (NULL, 'ridge', '2024-03-03'), (40, 'plain', NULL);
"""


@pytest.fixture
def q(engine, rows):
    rows(SETUP)
    return rows


def test_filter_order_top(q):
    assert q("SELECT TOP 2 Label FROM Star WHERE Mag <= 4 ORDER BY Mag, No DESC") == [("Castor",), ("Algol",)]
    assert [r[0] for r in q("SELECT Label FROM Star ORDER BY Label")] == [None, "Algol", "Castor", "Mira", "Rana"]
    assert [r[0] for r in q("SELECT No FROM Star ORDER BY Mag DESC, 1")] == [11, 14, 12, 13, 15]


def test_top_with_ties(q, fails):
    assert [r[0] for r in q("SELECT TOP 1 WITH TIES No FROM Star WHERE Mag > 0 ORDER BY Mag")] in ([12, 13], [13, 12])
    assert [r[0] for r in q("SELECT TOP (2) WITH TIES No FROM Star ORDER BY Mag")][0] == 15  # NULL comes first
    assert len(q("SELECT TOP (2) WITH TIES No FROM Star ORDER BY Mag")) == 3 and len(q("SELECT TOP (3) WITH TIES No FROM Star ORDER BY Mag DESC, Label DESC")) == 3
    assert len(q("SELECT TOP 50 WITH TIES No FROM Star ORDER BY Mag")) == 5 and q("SELECT TOP 0 WITH TIES No FROM Star ORDER BY Mag") == []
    assert q("SELECT TOP 1 WITH TIES Site, COUNT(*) AS n FROM Look GROUP BY Site ORDER BY COUNT(*) DESC") == [("ridge", 3)]
    assert "ORDER BY" in fails("SELECT TOP 1 WITH TIES No FROM Star")


def test_joins(q):
    assert q("SELECT s.Label, l.Site FROM Star s JOIN Look l ON s.No = l.StarNo ORDER BY l.Night, l.Site") == [("Mira", "ridge"), ("Mira", "coast"), ("Castor", "ridge")]
    sizes = {kind: len(q(f"SELECT * FROM Star s {kind} JOIN Look l ON s.No = l.StarNo")) for kind in ("LEFT", "RIGHT", "FULL")}
    assert sizes == {"LEFT": 6, "RIGHT": 5, "FULL": 8}
    assert len(q("SELECT * FROM Star CROSS JOIN Look")) == 25 and len(q("SELECT * FROM Star a, Star b WHERE a.Pair = b.No")) == 4
    assert sorted(q("SELECT a.No FROM Star a JOIN Star b ON a.Mag > b.Mag AND b.Label = 'Algol'")) == [(11,), (14,)]
    assert q("SELECT COUNT(*) FROM Star s JOIN (Look l JOIN (SELECT DISTINCT Site FROM Look) d ON l.Site = d.Site) ON s.No = l.StarNo") == [(3,)]


def test_unknown_is_neither_true_nor_false(q):
    assert q("SELECT COUNT(*) FROM Star a JOIN Look l ON a.Pair = l.StarNo") == [(4,)]
    assert q("SELECT No FROM Star WHERE NOT (Label = 'Mira') ORDER BY No") == [(12,), (13,), (15,)]
    assert q("SELECT No FROM Star WHERE Label NOT IN ('Mira', NULL)") == []
    assert q("SELECT No FROM Star WHERE Mag NOT BETWEEN 2 AND 5") == [(11,)]
    assert q("SELECT No FROM Star WHERE Pair IS NULL OR Mag IS NULL ORDER BY No") == [(11,), (15,)]


def test_two_valued_logic_on_demand(engine, q):
    engine.two_valued = True
    assert [r[0] for r in q("SELECT No FROM Star WHERE NOT (Label = 'Mira') ORDER BY No")] == [12, 13, 14, 15]
    assert [r[0] for r in q("SELECT No FROM Star WHERE No NOT IN (SELECT StarNo FROM Look) ORDER BY No")] == [12, 14, 15]


def test_subqueries(q, fails):
    assert q("SELECT Label FROM Star s WHERE EXISTS (SELECT 1 FROM Look WHERE StarNo = s.No) ORDER BY No") == [("Mira",), ("Castor",)]
    assert q("SELECT No, (SELECT COUNT(*) FROM Star x WHERE x.Pair = s.No) AS n FROM Star s WHERE No < 14 ORDER BY No") == [(11, 2), (12, 2), (13, 0)]
    assert q("SELECT (SELECT Label FROM Star WHERE No = 77) AS none") == [(None,)]
    assert q("SELECT Pair FROM Star GROUP BY Pair HAVING COUNT(*) = (SELECT COUNT(*) FROM Look WHERE StarNo = 11) ORDER BY Pair") == [(11,), (12,)]
    assert q("SELECT CASE WHEN No IN (SELECT StarNo FROM Look) THEN 'seen' ELSE 'not' END FROM Star WHERE No IN (11, 13)") == [("seen",), ("seen",)]
    assert "more than one row" in fails("SELECT (SELECT No FROM Star) AS many").lower()
    assert "one column" in fails("SELECT (SELECT 1, 2) AS two")


def test_ctes_and_derived_tables(q, fails):
    assert q("WITH a AS (SELECT No FROM Star), b (x) AS (SELECT No * 2 FROM a) SELECT SUM(x) FROM b") == [(130,)]
    assert q("SELECT d.k FROM (SELECT No, Label FROM Star) AS d(k, n) WHERE d.n = 'Rana'") == [(15,)]
    assert q("WITH Star AS (SELECT 7 AS No) SELECT No FROM Star") == [(7,)]
    assert "Invalid column" in fails("SELECT d.No FROM (SELECT No FROM Star) AS d(k)")


def test_aggregates(q):
    n, labels, total, least, last = q("SELECT COUNT(*), COUNT(Label), SUM(Mag), MIN(Mag), MAX(Label) FROM Star")[0]
    assert (n, labels, float(total), float(least), last) == (5, 4, 14.7, 2.1, "Rana")
    assert q("SELECT COUNT(*), SUM(No) FROM Star WHERE No > 100") == [(0, None)]
    assert q("SELECT COUNT(DISTINCT Pair) FROM Star") == [(2,)]
    assert q("SELECT Pair, COUNT(*) AS n FROM Star GROUP BY Pair HAVING COUNT(*) > 1 ORDER BY Pair") == [(11, 2), (12, 2)]
    assert q("SELECT CAST(SUM(No) AS INT) / COUNT(*) FROM Star") == [(13,)]


def test_string_agg(q):
    assert q("SELECT STRING_AGG(Site, ',') FROM Look") == [("coast,plain,ridge,ridge,ridge",)]
    assert q("SELECT STRING_AGG(DISTINCT Site, '/') FROM Look") == [("coast/plain/ridge",)]
    assert q("SELECT STRING_AGG(Label, ' ') WITHIN GROUP (ORDER BY No DESC) FROM Star") == [("Rana Castor Algol Mira",)]
    assert q("SELECT Pair, STRING_AGG(No, '+') WITHIN GROUP (ORDER BY Mag, No) AS s FROM Star WHERE Pair IS NOT NULL GROUP BY Pair ORDER BY Pair") == [(11, "12+13"), (12, "15+14")]


def test_an_aggregate_query_has_no_star(fails, q):
    assert "scalar select elements" in fails("SELECT * FROM Star GROUP BY No")


def test_set_operations_with_order(q):
    assert q("SELECT No FROM Star UNION SELECT StarNo FROM Look WHERE StarNo IS NOT NULL ORDER BY No DESC") == [(40,), (15,), (14,), (13,), (12,), (11,)]
    assert q("SELECT No FROM Star EXCEPT SELECT StarNo FROM Look ORDER BY 1") == [(12,), (14,), (15,)]
    assert q("(SELECT No FROM Star INTERSECT SELECT StarNo FROM Look) UNION ALL (SELECT 1 EXCEPT SELECT 2) ORDER BY No") == [(1,), (11,), (13,)]
    assert q("SELECT NULL AS a EXCEPT SELECT NULL") == []


def test_windows_and_paging(q):
    assert q("SELECT Label, ROW_NUMBER() OVER (PARTITION BY Pair ORDER BY No) AS n FROM Star WHERE Pair = 11 ORDER BY n") == [("Algol", 1), ("Castor", 2)]
    assert q("SELECT No, SUM(No) OVER (ORDER BY No ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM Star ORDER BY No") == [(11, 11), (12, 23), (13, 25), (14, 27), (15, 29)]
    assert q("SELECT No FROM Star ORDER BY No OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY") == [(12,), (13,)]


def test_select_into(q, fails, engine):
    q("SELECT No AS k, Mag, Label INTO Bright FROM Star WHERE Mag < 5")
    assert sorted(r[0] for r in q("SELECT k FROM Bright")) == [12, 13, 14]
    q("INSERT INTO Bright VALUES (99, 1.25, 'x'); UPDATE Bright SET Mag = 3 WHERE k = 12")
    assert [float(r[0]) for r in q("SELECT Mag FROM Bright WHERE k IN (12, 99) ORDER BY k")] == [3.0, 1.25]
    assert "already exists" in fails("SELECT 1 AS a INTO Bright")
    assert engine.get_table_info("Bright").row_count == 4


def test_string_plus_is_concatenation(q, fails):
    assert q("SELECT Label + '-' + CAST(No AS VARCHAR(5)) FROM Star WHERE No = 11") == [("Mira-11",)]
    assert q("SELECT 'a' + 1, 'a' + NULL, CONCAT('a', NULL, 1)") == [("a1", None, "a1")]
    assert "DATEADD" in fails("SELECT GETDATE() + 1")


def test_numbers(q, fails):
    assert q("SELECT 7/2, -7/2, 7 % 3, 7/2.0, 10 - 2 - 3") == [(3, -3, 1, pytest.approx(3.5), 5)]
    assert "zero" in fails("SELECT 1/0").lower()
    assert q("SELECT ROUND(2.345, 2), CAST(3.99 AS INT), CAST('12' AS INT), CONVERT(DECIMAL(6,1), 1.25)")[0][1:3] == (3, 12)


def test_dates(q):
    assert q("SELECT DATEDIFF(YEAR, '2023-12-31', '2024-01-01'), DATEDIFF(MONTH, '2024-01-31', '2024-02-01'), DATEDIFF(DAY, '2024-01-01T23:00:00', '2024-01-02T01:00:00'), DATEDIFF(HOUR, '2024-01-01T23:00:00', '2024-01-02T01:30:00')") == [(1, 1, 1, 2)]
    assert str(q("SELECT DATEADD(MONTH, 1, '2024-01-31')")[0][0]) == "2024-02-29 00:00:00"
    assert q("SELECT CAST(CAST('2024-01-02T03:04:05' AS DATETIME) AS VARCHAR(40))") == [("2024-01-02T03:04:05.0000000",)]
    assert [str(r[0])[:10] for r in q("SELECT Night FROM Look WHERE Night >= '2024-03-02' ORDER BY Night, Site")] == ["2024-03-02", "2024-03-02", "2024-03-03"]


def test_like_has_no_classes(q):
    assert q("SELECT 1 WHERE '[a]x' LIKE '[a]%'") == [(1,)]
    assert q("SELECT 1 WHERE 'ax' LIKE '[a]%'") == []
    assert q("SELECT 1 WHERE '50%' LIKE '50!%' ESCAPE '!' AND 'a\\b' LIKE 'a\\b'") == [(1,)]


def test_names(q, fails, engine):
    assert "ambiguous" in fails("SELECT No FROM Star a JOIN Star b ON a.No = b.No")
    assert "Invalid column" in fails("SELECT Nope FROM Star")
    assert "does not exist" in fails("SELECT 1 FROM Nope")
    r = engine.execute_query("SELECT a.No, b.No, a.No FROM Star a JOIN Star b ON a.No = b.No")
    assert r.columns == ["a.No", "b.No", "a.No_2"]
    assert q("SELECT [NO], star.LABEL FROM STAR WHERE no = 11") == [(11, "Mira")]


def test_where_without_from(q):
    assert q("SELECT 1 WHERE 1 = 0") == []


def test_generator_and_catalog_views(q):
    assert q("SELECT COUNT(*) FROM sys.all_objects") == [(2000,)]
    assert [r[0] for r in q("SELECT name FROM sys.tables ORDER BY name")] == ["Look", "Star"]
    assert q("SELECT COUNT(*) FROM sys.indexes") == [(0,)]
    assert [r[0] for r in q("SELECT name FROM sys.columns WHERE object_id = (SELECT object_id FROM sys.tables WHERE name = 'Look') ORDER BY column_id")] == ["StarNo", "Site", "Night"]
    assert q("SELECT COUNT(*) FROM sys.databases WHERE state_desc = 'ONLINE' AND name = 'lab'") == [(1,)]


def test_errors_are_results(engine, fails):
    assert fails("SELEC 1").startswith("Parse error")
    assert "No database selected" in fails("SELECT 1 FROM t", type(engine)(engine.spark, engine.root))


def test_rendering(engine, q):
    text = engine.execute_query("SELECT No, Label FROM Star WHERE No > 13 ORDER BY No").render()
    assert "NULL" in text and text.endswith("(2 row(s) returned)")
