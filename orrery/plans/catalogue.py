"""The registered queries of the SQL engine and the SQL that their results are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import run_over
from ..operators.column_math import Predicate, column_count, column_sum
from . import scenarios, surfaces

FLAGSHIP = "pricing_summary"

#: name: (T-SQL, SQL to compare with). Every query runs over whole tables; a TOP is there where TOP is the feature.
PAIRS: dict[str, tuple[str, str]] = {
    "pricing_summary": (
        """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           ROUND(AVG(l_quantity), 4) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
           round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    ),
    "scan_project_filter": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem WHERE l_quantity > 45 AND l_discount <> 0 AND l_returnflag = 'R'",
        "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem WHERE l_quantity > 45 AND l_discount <> 0 AND l_returnflag = 'R'",
    ),
    "between_like_in": (
        "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%a%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_type NOT LIKE 'S[T]%'",
        "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_name LIKE '%a%' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_type NOT LIKE 'S[T]%'",
    ),
    "like_escape": (
        "SELECT DISTINCT c_name FROM customer WHERE c_name LIKE 'Customer!#%' ESCAPE '!' OR c_mktsegment LIKE '_U%'",
        "SELECT DISTINCT c_name FROM customer WHERE c_name LIKE 'Customer!#%' ESCAPE '!' OR c_mktsegment LIKE '_U%'",
    ),
    "is_null_case": (
        """SELECT c.c_custkey, CASE WHEN o.o_orderkey IS NULL THEN 'none' WHEN o.o_totalprice > 150000 THEN 'large' ELSE 'small' END AS size, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS seg
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'""",
        """SELECT c.c_custkey, CASE WHEN o.o_orderkey IS NULL THEN 'none' WHEN o.o_totalprice > 150000 THEN 'large' ELSE 'small' END AS size, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS seg
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'""",
    ),
    "not_logic": (
        "SELECT p_partkey FROM part WHERE NOT (p_size = 5 OR p_size IN (1, 2, 3)) AND p_size NOT BETWEEN 30 AND 50 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
        "SELECT p_partkey FROM part WHERE NOT (p_size = 5 OR p_size IN (1, 2, 3)) AND p_size NOT BETWEEN 30 AND 50 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    ),
    "inner_join_hash": (
        "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
        "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    ),
    "join_theta": (
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a INNER JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    ),
    "left_join": (
        "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
        "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    ),
    "right_join": (
        "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
        "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    ),
    "full_join": (
        "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 10",
        "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 10",
    ),
    "cross_join": (
        "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
        "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    ),
    "comma_join_5way": (
        """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
        """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
           AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""",
    ),
    "parenthesised_join": (
        "SELECT n.n_name, r.r_name, s.s_suppkey FROM supplier s JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON s.s_nationkey = n.n_nationkey",
        "SELECT n.n_name, r.r_name, s.s_suppkey FROM supplier s JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON s.s_nationkey = n.n_nationkey",
    ),
    "exists_corr": (
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders o WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority",
        "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority",
    ),
    "not_exists_corr": (
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 100000)",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 100000)",
    ),
    "in_subquery": (
        "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
        "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
    ),
    "scalar_subquery_corr": (
        "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS most FROM customer c WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
        "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS most FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    ),
    "derived_table": (
        "SELECT d.status, d.n FROM (SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus) AS d(status, n) WHERE d.n > 10",
        "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) WHERE n > 10",
    ),
    "cte_chain": (
        "WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000), per (k, n, total) AS (SELECT k, COUNT(*), SUM(p) FROM big GROUP BY k) SELECT c.c_name, per.n, ROUND(per.total, 2) AS total FROM per JOIN customer c ON c.c_custkey = per.k WHERE per.n > 2",
        "WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000), per AS (SELECT k, count(*) AS n, sum(p) AS total FROM big GROUP BY k) SELECT c.c_name, per.n, round(per.total, 2) AS total FROM per JOIN customer c ON c.c_custkey = per.k WHERE per.n > 2",
    ),
    "values_join": (
        "SELECT v.label, COUNT(*) AS n FROM orders o JOIN (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) AS v(code, label) ON o.o_orderstatus = v.code GROUP BY v.label",
        "SELECT v.label, count(*) AS n FROM orders o JOIN (VALUES ('O', 'open'), ('F', 'filled'), ('P', 'partial')) AS v(code, label) ON o.o_orderstatus = v.code GROUP BY v.label",
    ),
    "from_less_select": (
        "SELECT 1 AS one, 'a' + 'b' AS ab, NULL AS nothing WHERE 1 = 1",
        "SELECT 1 AS one, 'ab' AS ab, NULL AS nothing",
    ),
    "row_generator": (
        "SELECT COUNT(*) AS n, MAX(k) AS most FROM (SELECT TOP (500) ROW_NUMBER() OVER (ORDER BY (SELECT NULL)) AS k FROM sys.all_objects ORDER BY k) AS g",
        "SELECT count(*) AS n, max(k) AS most FROM range(1, 501) t(k)",
    ),
    "group_by_multi": (
        "SELECT o_orderstatus, o_orderpriority, YEAR(o_orderdate) AS y, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority, YEAR(o_orderdate)",
        "SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
    ),
    "scalar_agg": (
        "SELECT COUNT(*) AS n, COUNT_BIG(l_tax) AS m, ROUND(SUM(l_extendedprice), 2) AS s, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, ROUND(AVG(l_discount), 6) AS a FROM lineitem",
        "SELECT count(*) AS n, count(l_tax) AS m, round(sum(l_extendedprice), 2) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_discount), 6) AS a FROM lineitem",
    ),
    "empty_agg": (
        "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_returnflag) AS lo FROM lineitem WHERE l_quantity < 0",
        "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_returnflag) AS lo FROM lineitem WHERE l_quantity < 0",
    ),
    "having_between": (
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) BETWEEN 5 AND 12 AND NOT MAX(o_totalprice) < 100000 AND MIN(o_orderstatus) IN ('F', 'O')",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 5 AND 12 AND NOT max(o_totalprice) < 100000 AND min(o_orderstatus) IN ('F', 'O')",
    ),
    "agg_ratio": (
        "SELECT ROUND(100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 4) AS promo, CAST(SUM(l_quantity) AS INT) AS q, -MAX(l_tax) AS t FROM lineitem JOIN part ON l_partkey = p_partkey",
        "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo, sum(l_quantity)::INT AS q, -max(l_tax) AS t FROM lineitem JOIN part ON l_partkey = p_partkey",
    ),
    "count_distinct": (
        "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "min_max_types": (
        "SELECT MIN(o_orderkey) AS a, MAX(o_totalprice) AS b, MIN(o_orderpriority) AS c, MAX(o_orderdate) AS d FROM orders",
        "SELECT min(o_orderkey) AS a, max(o_totalprice) AS b, min(o_orderpriority) AS c, max(o_orderdate) AS d FROM orders",
    ),
    "rollup": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    ),
    "cube": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)",
    ),
    "grouping_sets": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
    ),
    "statistics": (
        "SELECT l_returnflag, ROUND(STDEV(l_quantity), 6) AS sd, ROUND(STDEVP(l_quantity), 6) AS sdp, ROUND(VAR(l_discount), 8) AS v, ROUND(VARP(l_discount), 8) AS vp FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_discount), 8) AS v, round(var_pop(l_discount), 8) AS vp FROM lineitem GROUP BY l_returnflag",
    ),
    "string_agg": (
        "SELECT n_regionkey, STRING_AGG(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names, STRING_AGG(DISTINCT LEFT(n_name, 1), '') AS letters, STRING_AGG(n_name, '/') AS plain FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names, array_to_string(list_sort(list_distinct(list(left(n_name, 1)))), '') AS letters, string_agg(n_name, '/' ORDER BY n_name) AS plain FROM nation GROUP BY n_regionkey",
    ),
    "window_ranks": (
        """SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, NTILE(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS quarter, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first,
           LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders""",
        """SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS quarter, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first,
           last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders""",
    ),
    "window_frames": (
        "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sofar FROM orders",
        "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS run, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sofar FROM orders",
    ),
    "window_in_expression": (
        "SELECT o_orderkey, ROUND(100 * o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS share, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 'best' ELSE 'other' END AS kind FROM orders",
        "SELECT o_orderkey, round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS share, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 THEN 'best' ELSE 'other' END AS kind FROM orders",
    ),
    "top_with_ties": (
        "SELECT TOP (40) WITH TIES p_partkey, p_size FROM part WHERE p_size > 3 ORDER BY p_size DESC",
        "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part WHERE p_size > 3) WHERE r <= 40",
    ),
    "set_operation_order": (
        "SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region ORDER BY name DESC, k OFFSET 3 ROWS FETCH NEXT 9 ROWS ONLY",
        "SELECT k, name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region) ORDER BY name DESC, k LIMIT 9 OFFSET 3",
    ),
    "set_operation_nested": (
        "(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey FROM supplier) EXCEPT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey FROM supplier) EXCEPT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "derived_correlated": (
        "SELECT c_custkey, (SELECT MAX(d.p) FROM (SELECT o_totalprice AS p FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus <> 'P') AS d) AS most FROM customer c",
        "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus <> 'P') AS most FROM customer c",
    ),
    "subquery_places": (
        """SELECT o_custkey, COUNT(*) AS n, CASE WHEN MAX(o_totalprice) > (SELECT AVG(o_totalprice) FROM orders) THEN 'above' ELSE 'below' END AS side FROM orders GROUP BY o_custkey
           HAVING SUM(o_totalprice) > (SELECT 20 * AVG(o_totalprice) FROM orders) OR COUNT(*) = (SELECT COUNT(*) FROM region) ORDER BY (SELECT MIN(r_regionkey) FROM region), o_custkey""",
        """SELECT o_custkey, count(*) AS n, CASE WHEN max(o_totalprice) > (SELECT avg(o_totalprice) FROM orders) THEN 'above' ELSE 'below' END AS side FROM orders GROUP BY o_custkey
           HAVING sum(o_totalprice) > (SELECT 20 * avg(o_totalprice) FROM orders) OR count(*) = (SELECT count(*) FROM region)""",
    ),
    "session_functions": (
        "SELECT r_name, SCHEMA_NAME() AS s, USER_NAME() AS u, OBJECT_NAME('region') AS o, DATEDIFF(DAY, GETDATE(), SYSDATETIME()) AS d, DATEDIFF(HOUR, GETUTCDATE(), SYSUTCDATETIME()) AS h, CASE WHEN CURRENT_TIMESTAMP >= '2020-01-01' THEN 1 ELSE 0 END AS now, ISNULL(OBJECT_ID('x'), -1) AS id FROM region",
        "SELECT r_name, 'dbo' AS s, 'dbo' AS u, 'region' AS o, 0::BIGINT AS d, 0::BIGINT AS h, 1 AS now, -1 AS id FROM region",
    ),
    "more_date_parts": (
        "SELECT o_orderkey, DATEDIFF(QUARTER, '1990-02-01', o_orderdate) AS q, DATEDIFF(MINUTE, '1992-01-01', DATEADD(SECOND, 90, o_orderdate)) AS mi, DATEDIFF(SECOND, o_orderdate, DATEADD(MINUTE, 3, o_orderdate)) AS ss, DATEADD(WEEK, 2, o_orderdate) AS w, DATEADD(QUARTER, 1, o_orderdate) AS nq FROM orders",
        "SELECT o_orderkey, date_diff('quarter', TIMESTAMP '1990-02-01', o_orderdate) AS q, date_sub('minute', TIMESTAMP '1992-01-01', o_orderdate + INTERVAL 90 SECOND) AS mi, 180::BIGINT AS ss, o_orderdate + INTERVAL 14 DAY AS w, o_orderdate + INTERVAL 3 MONTH AS nq FROM orders",
    ),
    "null_inputs": (
        """SELECT c.c_custkey, LEN(o.o_orderstatus) AS n, UPPER(o.o_orderstatus) AS u, LEFT(o.o_orderstatus, 1) + '!' AS l, CONCAT('<', o.o_orderstatus, '>') AS cc, DATALENGTH('ab') AS dl, ABS(o.o_totalprice) AS a, YEAR(o.o_orderdate) AS y, REPLACE(o.o_orderpriority, '-', '') AS r
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000""",
        """SELECT c.c_custkey, length(o.o_orderstatus)::INT AS n, upper(o.o_orderstatus) AS u, left(o.o_orderstatus, 1) || '!' AS l, concat('<', o.o_orderstatus, '>') AS cc, 2 AS dl, abs(o.o_totalprice) AS a, year(o.o_orderdate)::INT AS y, replace(o.o_orderpriority, '-', '') AS r
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000""",
    ),
    "escaped_wildcards": (
        "SELECT p_partkey, CASE WHEN REPLACE(p_type, ' ', '_') LIKE '%!_A%' ESCAPE '!' THEN 1 ELSE 0 END AS a, CASE WHEN REPLACE(p_name, 'a', '%') LIKE '%!%%!%%' ESCAPE '!' THEN 1 ELSE 0 END AS two FROM part",
        "SELECT p_partkey, CASE WHEN replace(p_type, ' ', '_') LIKE '%!_A%' ESCAPE '!' THEN 1 ELSE 0 END AS a, CASE WHEN replace(p_name, 'a', '%') LIKE '%!%%!%%' ESCAPE '!' THEN 1 ELSE 0 END AS two FROM part",
    ),
    "row_number_partition": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    ),
    "row_number_topn": (
        "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) r WHERE rn <= 3",
        "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) r WHERE rn <= 3",
    ),
    "window_functions": (
        "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS r, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders",
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders",
    ),
    "order_top": (
        "SELECT TOP (25) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    ),
    "offset_fetch": (
        "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey OFFSET 10 ROWS FETCH NEXT 15 ROWS ONLY",
        "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 10",
    ),
    "order_ordinal_aggregate": (
        "SELECT TOP 5 o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY SUM(o_totalprice) DESC, 1",
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY sum(o_totalprice) DESC, 1 LIMIT 5",
    ),
    "distinct": (
        "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
        "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    ),
    "union_all": (
        "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier",
        "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier",
    ),
    "union_distinct": (
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "except_q": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000",
    ),
    "intersect_q": (
        "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') INTERSECT (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') ORDER BY k",
        "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    ),
    "string_functions": (
        """SELECT c_custkey, LEN(c_name) AS n, LEFT(c_name, 4) AS l, RIGHT(c_name, 3) AS r, SUBSTRING(c_name, 0, 5) AS s, UPPER(c_name) + '-' + LOWER(c_mktsegment) AS ul, REPLACE(c_name, 'Customer', 'C') AS rep,
           LTRIM(RTRIM('  x ')) + TRIM(' y ') AS t, CONCAT(c_custkey, '/', NULL, c_mktsegment) AS cc, CONCAT_WS('-', 'a', c_mktsegment) AS ws FROM customer""",
        """SELECT c_custkey, length(c_name)::INT AS n, left(c_name, 4) AS l, right(c_name, 3) AS r, substring(c_name, 1, 5) AS s, upper(c_name) || '-' || lower(c_mktsegment) AS ul, replace(c_name, 'Customer', 'C') AS rep,
           'xy' AS t, concat(c_custkey, '/', c_mktsegment) AS cc, concat_ws('-', 'a', c_mktsegment) AS ws FROM customer""",
    ),
    "math_functions": (
        "SELECT s_suppkey, ABS(s_acctbal) AS a, CEILING(s_acctbal) AS c, FLOOR(s_acctbal) AS f, ROUND(s_acctbal, 1) AS r, ROUND(2.345, 2) AS d, -s_suppkey AS neg, ABS(-3) AS i FROM supplier",
        "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(s_acctbal, 1) AS r, 2.35 AS d, -s_suppkey AS neg, 3 AS i FROM supplier",
    ),
    "date_functions": (
        """SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DATEADD(MONTH, 1, o_orderdate) AS nm, DATEADD(day, -3, o_orderdate) AS bd, DATEDIFF(YEAR, o_orderdate, '1999-01-01') AS dy,
           DATEDIFF(MONTH, o_orderdate, '1999-01-01') AS dm, DATEDIFF(DAY, '1992-01-01', o_orderdate) AS dd, DATEDIFF(HOUR, '1992-01-01T12:30:00', o_orderdate) AS dh FROM orders""",
        """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, o_orderdate + INTERVAL 1 MONTH AS nm, o_orderdate - INTERVAL 3 DAY AS bd, date_diff('year', o_orderdate, TIMESTAMP '1999-01-01') AS dy,
           date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS dm, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS dd, date_sub('hour', TIMESTAMP '1992-01-01 12:30:00', o_orderdate) AS dh FROM orders""",
    ),
    "cast_convert": (
        "SELECT event_id, CAST(value AS INT) AS i, CONVERT(DECIMAL(12,2), value) AS d, CAST(event_id AS VARCHAR(20)) + 'x' AS s, CAST(ts AS DATE) AS day, CAST('7' AS INT) + 1 AS n, CAST(3.99 AS INT) AS t, CAST(1 AS BIT) AS b FROM events",
        "SELECT event_id, trunc(value)::INT AS i, value::DECIMAL(12,2) AS d, event_id::VARCHAR || 'x' AS s, date_trunc('day', ts)::TIMESTAMP AS day, 8 AS n, 3 AS t, true AS b FROM events",
    ),
    "null_functions": (
        "SELECT c.c_custkey, ISNULL(o.o_orderstatus, 'none') AS st, COALESCE(o.o_totalprice, 0) AS p, NULLIF(c.c_mktsegment, 'BUILDING') AS seg FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000",
        "SELECT c.c_custkey, coalesce(o.o_orderstatus, 'none') AS st, coalesce(o.o_totalprice, 0) AS p, nullif(c.c_mktsegment, 'BUILDING') AS seg FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000",
    ),
    "int_division": (
        "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, (p_size + 1) / 2.0 AS h, p_partkey / 3 * 3 AS k FROM part",
        "SELECT p_partkey, p_size // 7 AS q, p_size % 7 AS r, ((p_size + 1) / 2.0)::DECIMAL(20,6) AS h, p_partkey // 3 * 3 AS k FROM part",
    ),
    "typed_comparison": (
        "SELECT event_id FROM events WHERE ts >= '2024-01-10' AND event_id < '5000' AND CAST(event_id % 2 AS BIT) = 1",
        "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_id < 5000 AND event_id % 2 = 1",
    ),
    "datetime_text": (
        "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR(40)) AS t FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '0' AS t FROM orders",
    ),
}


def _over(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_over(spark, sf_dir, sql)


def column_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    total = column_sum(items, "l_quantity", Predicate.GREATER_OR_EQUAL, 25).selectExpr("round(total, 2) AS total")
    return total.crossJoin(column_count(items, "l_discount", Predicate.EQUAL, 0.05))  # one row and one row


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_over(spark, sf_dir, PAIRS[FLAGSHIP][0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _over(sql) for name, (sql, _) in PAIRS.items()} | {"column_math": column_math} | scenarios.QUERIES | surfaces.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS.items()} | {
        "column_math": "SELECT round((SELECT sum(l_quantity) FROM lineitem WHERE l_quantity >= 25), 2) AS total, (SELECT count(*) FROM lineitem WHERE l_discount = 0.05) AS n"
    } | scenarios.ORACLE_SQL | surfaces.ORACLE_SQL
