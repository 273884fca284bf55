"""Relational queries: name -> Spark SQL, and DuckDB SQL where its text must differ."""

FLAGSHIP = """
WITH rev AS (
  SELECT n.n_name AS nation, o.o_orderpriority AS prio,
         SUM(CAST(floor(l.l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l.l_discount * 100 + 0.5) AS BIGINT))) AS revenue,
         COUNT(*) AS n_items
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE l.l_returnflag = 'R' GROUP BY n.n_name, o.o_orderpriority HAVING COUNT(*) > 1)
SELECT nation, prio, CAST(revenue AS DOUBLE) / 10000 AS revenue, n_items,
       CAST(RANK() OVER (PARTITION BY nation ORDER BY revenue DESC) AS BIGINT) AS rk FROM rev
"""

# Amounts are summed as whole cents: exact in any order, and a sum of longs needs no object a row as one of decimals does.
_D = "CAST(floor({} * 100 + 0.5) AS BIGINT)"
_PRICE, _QTY, _TOTAL = _D.format("l_extendedprice"), _D.format("l_quantity"), _D.format("o_totalprice")

#: One text for both engines.
SAME = {
    "flagship_revenue_rank": FLAGSHIP,
    "scan_point": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77",
    "scan_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 180 AND o_totalprice > 1000",
    "range_agg": f"SELECT COUNT(*) AS n, CAST(SUM({_TOTAL}) AS DOUBLE) / 100 AS s FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 1101",
    "full_agg": f"SELECT COUNT(*) AS n, CAST(SUM({_QTY}) AS DOUBLE) / 100 AS s, CAST(AVG(l_linenumber) AS DOUBLE) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem",
    "project_alias": "SELECT c_custkey AS id, upper(c_mktsegment) AS segment, c_nationkey + 1 AS next_nation FROM customer",
    "select_without_from": "SELECT 1 + 2 AS three, 'a' || 'b' AS ab WHERE 1 = 1",
    "derived_table": "SELECT k, n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 10",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE 'z%'",
    "filter_ilike": "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'brand#1%'",
    "filter_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN ('BUILDING')",
    "filter_between": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey NOT BETWEEN 3 AND 6",
    "filter_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS word FROM part",
    "filter_null": "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer WHERE nullif(c_nationkey, 3) IS NULL OR (nullif(c_nationkey, 4) IS NOT NULL AND c_custkey < 50)",
    "filter_logic": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 5000) AND o_custkey <> 7",
    "row_value_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((CAST(1 AS BIGINT), 1), (CAST(2 AS BIGINT), 2), (CAST(3 AS BIGINT), 1))",
    "row_value_compare": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (CAST(5 AS BIGINT), 3)",
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 9000",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey AND s.s_acctbal < 0",
    "join_full": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 8) b ON a.n_nationkey = b.n_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_using": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)",
    "join_natural": "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_self": "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey",
    "join_chain": "SELECT r_name, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name",
    "join_null_keys": "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a LEFT JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k",
    "semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "multi_col_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT l_orderkey, MIN(l_partkey) FROM lineitem GROUP BY l_orderkey)",
    "agg_group": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM({_QTY}) AS DOUBLE) / 100 AS sum_qty, CAST(SUM({_PRICE}) AS DOUBLE) / 100 AS sum_price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": f"SELECT o_custkey, COUNT(*) AS n, CAST(SUM({_TOTAL}) AS DOUBLE) / 100 AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MIN(o_totalprice) > 1000",
    "agg_having_no_group": "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10",
    "agg_expr_over_agg": f"SELECT l_returnflag, CAST(SUM({_PRICE}) AS DOUBLE) / 100 / COUNT(*) AS mean_price, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag",
    "agg_avg_double": f"SELECT o_orderstatus, CAST(SUM({_TOTAL}) AS DOUBLE) / 100 / COUNT(*) AS a, AVG(o_custkey) AS mean_key FROM orders GROUP BY o_orderstatus",
    "agg_minmax_string": "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer GROUP BY c_mktsegment",
    "agg_distinct_count": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_orderpriority) AS m FROM orders WHERE o_orderkey < 0",
    "agg_null_group": "SELECT k, COUNT(*) AS n, COUNT(k) AS nk FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) t GROUP BY k",
    "agg_having_subquery": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) / 1000 + 3 FROM orders WHERE o_orderkey < 1000)",
    "ext_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "ext_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "ext_sum_over": f"SELECT o_orderkey, CAST(SUM({_TOTAL}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) / 100 AS running FROM orders",
    "ext_frame": f"SELECT o_orderkey, CAST(SUM({_TOTAL}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) / 100 AS last_three FROM orders",
    "win_row_number": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank": "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS rk FROM orders",
    "win_dense_rank": "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS rk FROM orders",
    "win_lead": "SELECT o_orderkey, LEAD(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_order, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS second_next FROM orders",
    "win_lag": "SELECT o_orderkey, LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, LAG(o_orderkey, 3, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS third FROM orders",
    "win_first": "SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type FROM events",
    "win_last": "SELECT event_id, LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type FROM events",
    "win_ntile": "SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS quarter FROM orders",
    "win_in_expression": "SELECT o_orderkey, CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'first' ELSE 'later' END AS which FROM orders",
    "sort_multi": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey",
    "sort_nulls": "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST, c_custkey",
    "limit_offset": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 35",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_sorted": "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) t ORDER BY k DESC LIMIT 5",
    "cte_chain": "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b(key, count_of) AS (SELECT k, n FROM a WHERE n > 5) SELECT key, count_of, c_name FROM b JOIN customer ON key = c_custkey",
    "cte_recursive_sequence": "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS square FROM s",
    "cte_recursive_hierarchy": "WITH RECURSIVE h(id, name, level) AS (SELECT n_nationkey, n_name, 1 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_name, h.level + 1 FROM nation n JOIN h ON n.n_nationkey > 0 AND CAST(floor((n.n_nationkey - 1) / 2) AS INT) = h.id) SELECT id, name, level FROM h",
}

#: name -> (Spark SQL, DuckDB SQL)
PAIRS = {
    "filter_regex": (
        "SELECT p_partkey, p_name FROM part WHERE p_brand RLIKE '#[1-3]' AND p_type RLIKE '(?i)a' AND NOT p_name RLIKE '^q'",
        "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND regexp_matches(p_type, '(?i)a') AND NOT regexp_matches(p_name, '^q')",
    ),
    "cast_matrix": (
        "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS b, CAST(o_totalprice AS DECIMAL(12,1)) > 1000 AS d, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(DATE '2024-02-29' AS STRING) AS leap FROM orders",
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b, CAST(o_totalprice AS DECIMAL(12,1)) > 1000 AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(DATE '2024-02-29' AS VARCHAR) AS leap FROM orders",
    ),
    "arith_integers": (
        "SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderkey * 2 + 1 AS odd FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -o_orderkey AS neg, o_orderkey * 2 + 1 AS odd FROM orders",
    ),
    "date_interval": (
        "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP_NTZ) AS a, CAST(o_orderdate - INTERVAL 36 HOUR AS TIMESTAMP_NTZ) AS b FROM orders",
        "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 36 HOUR AS b FROM orders",
    ),
    "dual_row": ("SELECT dummy FROM dual", "SELECT 'X' AS dummy"),
}
