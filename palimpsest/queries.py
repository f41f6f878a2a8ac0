"""The registered queries: dialect statements over the driver's tables, each with its DuckDB twin.

A text may serve both engines. ``@n[ x ]@`` rounds x half to even at n digits in either one, so that sums of doubles that
were added in another order compare equal.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.recursion import shared_folder
from palimpsest.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DOCUMENT_COLUMNS = {"events": ("props",)}

#: name -> (dialect text, DuckDB text; None: the same text)
PAIRS: dict[str, tuple[str, str | None]] = {}


def both(name: str, sql: str, duck: str | None = None) -> None:
    PAIRS[name] = (sql, duck)


def spelled(sql: str, duck: bool) -> str:
    """Rounding marks as either engine writes them."""

    def one(m: re.Match) -> str:
        scale = f"1{'0' * int(m[1])}.0"
        return f"(round_even(({m[2]}) * {scale}, 0) / {scale})" if duck else f"(ROUND(({m[2]}) * {scale}) / {scale})"

    return re.sub(r"@(\d)\[(.*?)\]@", one, sql, flags=re.DOTALL)


# -- TPC-H, on the columns that the tables have. partsupp is the pairs of part and supplier that were ordered.

PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN(l_extendedprice / l_quantity) AS ps_supplycost, SUM(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey) AS partsupp"

both(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, @2[SUM(l_quantity)]@ AS sum_qty, @2[SUM(l_extendedprice)]@ AS sum_base_price,
  @2[SUM(l_extendedprice * (1 - l_discount))]@ AS sum_disc_price, @2[SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax))]@ AS sum_charge,
  @4[AVG(l_quantity)]@ AS avg_qty, @4[AVG(l_extendedprice)]@ AS avg_price, @6[AVG(l_discount)]@ AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
both(
    "tpch_q2",
    f"""SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, @4[ps_supplycost]@ AS supplycost
FROM part, supplier, {PARTSUPP}, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT MIN(ps_supplycost) FROM {PARTSUPP}, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
both(
    "tpch_q3",
    """SELECT l_orderkey, @2[SUM(l_extendedprice * (1 - l_discount))]@ AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
both(
    "tpch_q4",
    """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
both(
    "tpch_q5",
    """SELECT n_name, @2[SUM(l_extendedprice * (1 - l_discount))]@ AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
)
both("tpch_q6", "SELECT @2[SUM(l_extendedprice * l_discount)]@ AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
both(
    "tpch_q7",
    """SELECT supp_nation, cust_nation, l_year, @2[SUM(volume)]@ AS revenue
FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, EXTRACT(YEAR FROM l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
      FROM supplier, lineitem, orders, customer, nation AS n1, nation AS n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))
        AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
both(
    "tpch_q8",
    """SELECT o_year, @6[SUM(CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0.0 END) / SUM(volume)]@ AS mkt_share
FROM (SELECT EXTRACT(YEAR FROM o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
      FROM part, supplier, lineitem, orders, customer, nation AS n1, nation AS n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
        AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year ORDER BY o_year""",
)
both(
    "tpch_q9",
    f"""SELECT nation_name, o_year, @2[SUM(amount)]@ AS sum_profit
FROM (SELECT n_name AS nation_name, EXTRACT(YEAR FROM o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
      FROM part, supplier, lineitem, {PARTSUPP}, orders, nation
      WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%blue%') AS profit
GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
)
both(
    "tpch_q10",
    """SELECT c_custkey, c_name, @2[SUM(l_extendedprice * (1 - l_discount))]@ AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
both(
    "tpch_q11",
    f"""SELECT ps_partkey, @2[SUM(ps_supplycost * ps_availqty)]@ AS val
FROM {PARTSUPP}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
GROUP BY ps_partkey
HAVING SUM(ps_supplycost * ps_availqty) > (SELECT SUM(ps_supplycost * ps_availqty) * 0.001 FROM {PARTSUPP}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3')
ORDER BY val DESC, ps_partkey""",
)
both(
    "tpch_q12",
    """SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus ORDER BY l_linestatus""",
)
both(
    "tpch_q13",
    """SELECT c_count, COUNT(*) AS custdist
FROM (SELECT c_custkey, COUNT(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
)
both(
    "tpch_q14",
    "SELECT @6[100.0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / SUM(l_extendedprice * (1 - l_discount))]@ AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'",
)
both(
    "tpch_q15",
    """WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, @2[SUM(l_extendedprice * (1 - l_discount))]@ FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey""",
)
both(
    "tpch_q16",
    f"""SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {PARTSUPP}, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
)
both("tpch_q17", "SELECT @4[SUM(l_extendedprice) / 7.0]@ AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.2 * AVG(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)")
both(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS orderdate, o_totalprice, @2[SUM(l_quantity)]@ AS qty
FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
both(
    "tpch_q19",
    """SELECT @2[SUM(l_extendedprice * (1 - l_discount))]@ AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 25)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 35)""",
)
both(
    "tpch_q20",
    f"""SELECT s_name FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM {PARTSUPP} WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
    AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01'))
  AND s_nationkey = n_nationkey AND n_regionkey = 1 ORDER BY s_name""",
)
both(
    "tpch_q21",
    """SELECT s_name, COUNT(*) AS numwait FROM supplier, lineitem AS l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT * FROM lineitem AS l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem AS l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name = 'NATION_20' GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
both(
    "tpch_q22",
    """SELECT p_brand, COUNT(*) AS numpart, @2[SUM(p_retailprice)]@ AS total FROM part
WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part WHERE p_size > 0) AND NOT EXISTS (SELECT * FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01')
GROUP BY p_brand ORDER BY p_brand""",
)

# -- filters and predicates

both("filter_between", "SELECT COUNT(*) AS n, @2[SUM(l_tax)]@ AS tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_tax NOT BETWEEN 0.02 AND 0.04")
both("filter_in_list", "SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size IN (1, 5, 9, NULL) AND p_type NOT IN ('PROMO', 'SMALL') GROUP BY p_brand")
both("filter_like_escape", r"SELECT n_name FROM nation WHERE n_name LIKE 'NATION\_1%' ESCAPE '\'".replace("\\", "!"))
both("filter_glob", "SELECT p_name, COUNT(*) AS n FROM part WHERE p_name GLOB 'b*e ?nv*' GROUP BY p_name")
both("filter_regexp", "SELECT c_custkey FROM customer WHERE c_name REGEXP '0[1-3]+$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[1-3]+$')")
both("filter_three_valued", "SELECT (NULL AND FALSE) AS a, (NULL OR TRUE) AS b, (NOT NULL = 1) AS c, (1 IN (2, NULL)) AS d, (NULL IS NULL) AS e, (2 IS NOT DISTINCT FROM NULL) AS f")
both("filter_is_distinct", "SELECT a.n_nationkey FROM nation AS a LEFT JOIN region AS b ON a.n_nationkey = b.r_regionkey WHERE b.r_regionkey IS DISTINCT FROM 2 AND b.r_name IS NULL")
both(
    "case_searched",
    """SELECT CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS grp, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS seg, COUNT(*) AS n
FROM customer GROUP BY CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END""",
)
both("in_subquery_null", "SELECT c_custkey, c_nationkey IN (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region) AS hit FROM customer")
both("not_in_subquery", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
both("quant_any", "SELECT s_suppkey, s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = s_nationkey) AS richer FROM supplier")
both("quant_all", "SELECT s_suppkey, s_acctbal >= ALL (SELECT t.s_acctbal FROM supplier AS t WHERE t.s_nationkey = supplier.s_nationkey) AS richest FROM supplier")
both("scalar_subquery", "SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT MAX(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS best FROM nation")
both("semi_exists", "SELECT COUNT(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
both("anti_not_exists", "SELECT COUNT(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")

# -- joins

both("join_inner_using", "SELECT a.event_type, COUNT(*) AS n FROM events AS a JOIN events AS b USING (event_id, user_id) GROUP BY a.event_type")
both("join_left", "SELECT n_name, COUNT(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name")
both("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey + n_nationkey = 10")
both("join_multi_key", "SELECT COUNT(*) AS n, CAST(SUM(a.l_linenumber) AS BIGINT) AS s FROM lineitem AS a, lineitem AS b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity > 25")
both("lateral_subquery", "SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name DESC LIMIT 2) AS t")
both("lateral_left", "SELECT n_name, t.best FROM nation LEFT JOIN LATERAL (SELECT MAX(c_acctbal) AS best FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS t ON TRUE")

# -- aggregation

both(
    "agg_all_kinds",
    """SELECT event_type, COUNT(*) AS n, COUNT(value) AS nv, @4[SUM(value)]@ AS s, @4[TOTAL(value)]@ AS t, @6[AVG(value)]@ AS a, MIN(value) AS lo, MAX(value) AS hi, CAST(SUM(user_id) AS BIGINT) AS su FROM events GROUP BY event_type""",
    """SELECT event_type, COUNT(*) AS n, COUNT(value) AS nv, @4[SUM(value)]@ AS s, @4[SUM(value)]@ AS t, @6[AVG(value)]@ AS a, MIN(value) AS lo, MAX(value) AS hi, CAST(SUM(user_id) AS BIGINT) AS su FROM events GROUP BY event_type""",
)
both("agg_global_empty", "SELECT COUNT(*) AS n, SUM(n_nationkey) AS s, TOTAL(n_nationkey) AS t, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS s, CAST(0 AS DOUBLE) AS t, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0")
both("agg_distinct", "SELECT event_type, COUNT(DISTINCT user_id) AS users, CAST(SUM(DISTINCT user_id) AS BIGINT) AS s FROM events GROUP BY event_type")
both("agg_filter", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS dear, @2[SUM(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW')]@ AS low FROM orders GROUP BY o_orderstatus")
both("agg_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
both("agg_array_agg_ordered", "SELECT n_regionkey, ARRAY_AGG(n_nationkey ORDER BY n_name DESC) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_agg(CAST(n_nationkey AS BIGINT) ORDER BY n_name DESC) AS keys FROM nation GROUP BY n_regionkey")
both("agg_object_agg", "SELECT o.r AS region_key, o.x.NATION_1 AS one FROM (SELECT n_regionkey AS r, OBJECT_AGG(n_name, n_nationkey) AS x FROM nation GROUP BY n_regionkey) AS o", "SELECT n_regionkey AS region_key, MAX(CASE WHEN n_name = 'NATION_1' THEN CAST(n_nationkey AS BIGINT) END) AS one FROM nation GROUP BY n_regionkey")
both("agg_by_expression", "SELECT n_nationkey % 3 AS k, COUNT(*) AS n FROM nation GROUP BY n_nationkey % 3 HAVING COUNT(*) > 8")
both("having_no_group", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1")

# -- correlation through more than one query

both("corr_skip_level", "SELECT c.c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice > c.c_acctbal * 10))")
both("corr_skip_level_scalar", "SELECT r.r_name, (SELECT MAX(n.n_nationkey) FROM nation AS n WHERE n.n_nationkey <= (SELECT COUNT(*) FROM supplier AS s WHERE s.s_nationkey % 5 = r.r_regionkey)) AS k FROM region AS r")
both("corr_skip_level_no_from", "SELECT n.n_nationkey AS k, (SELECT (SELECT n.n_nationkey + 1)) AS j FROM nation AS n")

# -- sort, limit, distinct, set operations

both("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
both("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
both("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("except", "SELECT c_nationkey + 3 AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
both("setops_left_to_right", "SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT s_suppkey FROM supplier", "SELECT * FROM (SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation) INTERSECT SELECT s_suppkey FROM supplier")
both("order_nulls", "SELECT r_name, CASE WHEN r_regionkey > 1 THEN r_regionkey END AS k FROM region ORDER BY k, r_name LIMIT 3", "SELECT r_name, CASE WHEN r_regionkey > 1 THEN r_regionkey END AS k FROM region ORDER BY k NULLS FIRST, r_name LIMIT 3")
both("order_expression", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey DESC LIMIT 50")
both("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
both("distinct", "SELECT DISTINCT p_brand, p_size FROM part")
both("values_rows", "SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS v", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS v(a, b)")
both("objects_rows", "SELECT o.a, o.b, o.c FROM (OBJECTS {a: 1, b: 'x'}, {a: 2, c: 3.5}) AS o", "SELECT a, b, CAST(c AS DOUBLE) AS c FROM (VALUES (1, 'x', NULL), (2, NULL, 3.5)) AS o(a, b, c)")

# -- common table expressions

both("cte", "WITH big (k, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey), rich AS (SELECT k FROM big WHERE total > 1000000.0) SELECT COUNT(*) AS n FROM rich JOIN customer ON c_custkey = k")
both("cte_recursive", "WITH RECURSIVE steps (n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM steps WHERE n < 60) SELECT n, s FROM steps")
both("cte_recursive_union", "WITH RECURSIVE reach (k) AS (SELECT 1 UNION SELECT (k * 3 + n_regionkey) % 40 FROM reach, nation WHERE n_nationkey = k % 25) SELECT k FROM reach")

# -- scalar functions

both("int_division", "SELECT l_orderkey, l_linenumber, l_partkey / 7 AS q, l_partkey % 7 AS m, l_partkey / (l_linenumber - 1) AS z FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, l_partkey % 7 AS m, CASE WHEN l_linenumber <> 1 THEN l_partkey // (l_linenumber - 1) END AS z FROM lineitem")
both("bit_operators", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, ~p_partkey AS n, p_partkey << 2 AS l, p_partkey >> 1 AS r FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, ~p_partkey AS n, p_partkey * 4 AS l, p_partkey // 2 AS r FROM part")
both(
    "math_pack",
    """SELECT s_suppkey, ABS(s_acctbal) AS ab, SIGN(s_acctbal) AS sg, ROUND(s_acctbal) AS ro, FLOOR(s_acctbal) AS fl, CEIL(s_acctbal) AS ce, @6[SQRT(ABS(s_acctbal))]@ AS sq, @6[LN(s_suppkey)]@ AS l1, @6[LOG(s_suppkey)]@ AS l2, @6[LOG(2, s_suppkey)]@ AS l3, @6[LOG2(s_suppkey)]@ AS l4, @6[EXP(s_suppkey / 100.0)]@ AS ex, @6[POWER(s_suppkey, 0.5)]@ AS pw, MOD(s_suppkey, 3) AS mo FROM supplier""",
    """SELECT s_suppkey, ABS(s_acctbal) AS ab, CAST(SIGN(s_acctbal) AS BIGINT) AS sg, round_even(s_acctbal, 0) AS ro, FLOOR(s_acctbal) AS fl, CEIL(s_acctbal) AS ce, @6[SQRT(ABS(s_acctbal))]@ AS sq, @6[LN(NULLIF(s_suppkey, 0))]@ AS l1, @6[LOG10(NULLIF(s_suppkey, 0))]@ AS l2, @6[LOG2(NULLIF(s_suppkey, 0))]@ AS l3, @6[LOG2(NULLIF(s_suppkey, 0))]@ AS l4, @6[EXP(CAST(s_suppkey AS DOUBLE) / 100)]@ AS ex, @6[POWER(CAST(s_suppkey AS DOUBLE), 0.5)]@ AS pw, s_suppkey % 3 AS mo FROM supplier""",
)
both(
    "trig_pack",
    """SELECT s_suppkey, @6[SIN(s_suppkey)]@ AS a, @6[COS(s_suppkey)]@ AS b, @6[ATAN(s_suppkey)]@ AS c, @6[ATAN2(s_suppkey, 3)]@ AS d, @6[ASIN(1.0 / (s_suppkey + 1))]@ AS e, @6[ACOS(1.0 / (s_suppkey + 1))]@ AS f, @6[TANH(s_suppkey / 50.0)]@ AS g, @6[ASINH(s_suppkey)]@ AS h, @6[ACOSH(s_suppkey + 1)]@ AS i, @6[ATANH(1.0 / (s_suppkey + 2))]@ AS j, @6[DEGREES(s_suppkey)]@ AS k, @6[RADIANS(s_suppkey)]@ AS l, @6[PI()]@ AS m, @6[SINH(s_suppkey / 50.0)]@ AS o, @6[COSH(s_suppkey / 50.0)]@ AS p, @4[TAN(s_suppkey)]@ AS q FROM supplier""",
    """SELECT s_suppkey, @6[SIN(x)]@ AS a, @6[COS(x)]@ AS b, @6[ATAN(x)]@ AS c, @6[ATAN2(x, 3)]@ AS d, @6[ASIN(1 / (x + 1))]@ AS e, @6[ACOS(1 / (x + 1))]@ AS f, @6[TANH(x / 50)]@ AS g, @6[ASINH(x)]@ AS h, @6[ACOSH(x + 1)]@ AS i, @6[ATANH(1 / (x + 2))]@ AS j, @6[DEGREES(x)]@ AS k, @6[RADIANS(x)]@ AS l, @6[PI()]@ AS m, @6[SINH(x / 50)]@ AS o, @6[COSH(x / 50)]@ AS p, @4[TAN(x)]@ AS q FROM (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS x FROM supplier)""",
)
both("min_max_scalar", "SELECT n_nationkey, MIN(n_nationkey, n_regionkey, 3) AS lo, MAX(n_nationkey, n_regionkey) AS hi, MAX(n_nationkey, NULL) AS nothing FROM nation", "SELECT n_nationkey, least(n_nationkey, n_regionkey, 3) AS lo, greatest(n_nationkey, n_regionkey) AS hi, CAST(NULL AS BIGINT) AS nothing FROM nation")
both(
    "string_pack",
    """SELECT p_partkey, p_name || '-' || p_brand AS j, CHARACTER_LENGTH(p_name) AS n, OCTET_LENGTH(p_name) AS o, LENGTH(p_name) AS l, UPPER(p_name) AS u, LOWER(p_brand) AS w, TRIM('  a ') AS t, LTRIM(p_name, 'bl') AS lt, RTRIM(p_name, 'el') AS rt, REPLACE(p_name, 'e', 'E') AS r, SUBSTRING(p_name, 2, 3) AS s, SUBSTRING(p_name FROM 3) AS s2, SUBSTR(p_name, -3) AS s3, INSTR(p_name, 'u') AS i, POSITION('l' IN p_name) AS p, UNICODE(p_name) AS c, CHAR(65, 66) AS ch FROM part""",
    """SELECT p_partkey, p_name || '-' || p_brand AS j, LENGTH(p_name) AS n, strlen(p_name) AS o, LENGTH(p_name) AS l, UPPER(p_name) AS u, LOWER(p_brand) AS w, 'a' AS t, LTRIM(p_name, 'bl') AS lt, RTRIM(p_name, 'el') AS rt, REPLACE(p_name, 'e', 'E') AS r, SUBSTRING(p_name, 2, 3) AS s, SUBSTRING(p_name, 3) AS s2, right(p_name, 3) AS s3, INSTR(p_name, 'u') AS i, INSTR(p_name, 'l') AS p, unicode(p_name) AS c, 'AB' AS ch FROM part""",
)
both("blob_pack", "SELECT n_name, HEX(n_name) AS h, BASE64(CAST(n_name AS BLOB)) AS b, SHA1(n_name) AS s, CAST(UNHEX(HEX(n_name)) AS TEXT) AS u, LENGTH(x'CAFE') AS l, UNHEX('ABC') IS NULL AS odd FROM nation", "SELECT n_name, hex(n_name) AS h, base64(encode(n_name)) AS b, sha1(n_name) AS s, n_name AS u, 2 AS l, TRUE AS odd FROM nation")
both("conditional_pack", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, IFNULL(NULL, n_name) AS b, IIF(n_regionkey > 2, 'hi', 'lo') AS c, TYPEOF(n_name) AS d, TYPEOF(n_nationkey) AS e, TYPEOF(NULL) AS f FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, n_name AS b, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS c, 'text' AS d, 'integer' AS e, 'null' AS f FROM nation")
both("cast_pack", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS i, CAST('12abc' AS INTEGER) AS t, CAST(l_quantity AS VARCHAR) AS v, CAST(l_linenumber AS DOUBLE) AS d, CAST(1 AS BOOLEAN) AS b, CAST('2001-02-03' AS DATE) = DATE '2001-02-03' AS dt FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS i, 12 AS t, CAST(l_quantity AS VARCHAR) AS v, CAST(l_linenumber AS DOUBLE) AS d, TRUE AS b, TRUE AS dt FROM lineitem")
both(
    "date_extract",
    "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, @6[EXTRACT(SECOND FROM ts)]@ AS s FROM events",
    "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, @6[(EXTRACT(MICROSECOND FROM ts)) / 1000000.0]@ AS s FROM events",
)
both("strftime", "SELECT event_id, STRFTIME('%Y/%m/%d %H:%M:%S', ts) AS t, @4[UNIXEPOCH(ts)]@ AS u, @4[JULIANDAY(ts)]@ AS j, CAST(DATE(ts) AS VARCHAR) AS d FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS t, @4[epoch_us(ts) / 1000000.0]@ AS u, @4[epoch_us(ts) / 86400000000.0 + 2440587.5]@ AS j, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events")
both("strftime_weeks", "SELECT o_orderkey, STRFTIME('%U %W %V %G %u %j %D', o_orderdate) AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%U %W %V %G %u %j %m/%d/%y') AS t FROM orders")
both("substring_edges", "SELECT n_name, SUBSTRING(n_name, 0, 2) AS a, SUBSTR(n_name, 0) AS b, SUBSTRING(n_name, -2, 1) AS c, SUBSTRING(n_name, 8, 9) AS d, HEX(SUBSTRING(CAST(n_name AS BLOB), 2, 3)) AS e FROM nation", "SELECT n_name, '' AS a, '' AS b, substr(n_name, -2, 1) AS c, substr(n_name, 8, 9) AS d, hex(substr(n_name, 2, 3)) AS e FROM nation")
both("interval_arithmetic", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1-1' YEAR TO MONTH AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) - P10D AS VARCHAR) AS b, o_orderdate + PT36H > o_orderdate AS c FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 13 MONTH AS DATE) AS VARCHAR) AS a, CAST(CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS VARCHAR) AS b, TRUE AS c FROM orders")
PERIODS = [("period_contains", "CONTAINS", "a.s <= b.s AND a.e >= b.e"), ("period_overlaps", "OVERLAPS", "a.s < b.e AND a.e > b.s"), ("period_precedes", "PRECEDES", "a.e <= b.s"), ("period_succeeds", "SUCCEEDS", "a.s >= b.e"), ("period_immediately_precedes", "IMMEDIATELY PRECEDES", "a.e = b.s"), ("period_immediately_succeeds", "IMMEDIATELY SUCCEEDS", "a.s = b.e"), ("period_equals", "EQUALS", "a.s = b.s AND a.e = b.e")]
for _name, _word, _test in PERIODS:
    both(
        _name,
        f"WITH p (k, span) AS (SELECT s_suppkey, PERIOD(DATE('2024-01-' || (10 + s_suppkey % 9)), DATE('2024-01-' || (11 + s_suppkey % 9 + s_suppkey % 4))) FROM supplier) SELECT a.k AS x, b.k AS y FROM p AS a, p AS b WHERE a.span {_word} b.span",
        f"WITH p AS (SELECT s_suppkey AS k, CAST('2024-01-' || (10 + s_suppkey % 9) AS DATE) AS s, CAST('2024-01-' || (11 + s_suppkey % 9 + s_suppkey % 4) AS DATE) AS e FROM supplier) SELECT a.k AS x, b.k AS y FROM p AS a, p AS b WHERE {_test}",
    )

# -- vectors

both("vec_l2", "SELECT vec_id, @6[embedding <-> [" + ", ".join(["0.1"] * 64) + "]]@ AS d FROM embeddings", "SELECT vec_id, @6[list_distance(CAST(embedding AS DOUBLE[]), list_resize(CAST([] AS DOUBLE[]), 64, CAST(0.1 AS DOUBLE)))]@ AS d FROM embeddings")
both("vec_inner", "SELECT a.vec_id, @6[INNER_PRODUCT(a.embedding, a.embedding)]@ AS p, @6[a.embedding <#> a.embedding]@ AS neg FROM embeddings AS a", "SELECT vec_id, @6[list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))]@ AS p, @6[-list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))]@ AS neg FROM embeddings")
both("vec_cosine_topk", "SELECT b.vec_id, @6[a.embedding <=> b.embedding]@ AS d FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY d, b.vec_id LIMIT 10", "SELECT b.vec_id, @6[list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))]@ AS d FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY d, b.vec_id LIMIT 10")

# -- arrays, objects, paths

both("unnest_ordinality", "SELECT r_regionkey, u.v, u.i FROM region, UNNEST([r_name, 'x', NULL]) WITH ORDINALITY AS u (v, i)", "SELECT r_regionkey, unnest([r_name, 'x', NULL]) AS v, unnest([0, 1, 2]) AS i FROM region")
both("unnest_two", "SELECT r_regionkey, u.a, u.b FROM region, UNNEST([1, 2, 3], ['p', 'q']) AS u (a, b)", "SELECT r_regionkey, a, b FROM region, (VALUES (1, 'p'), (2, 'q'), (3, NULL)) AS u(a, b)")
both("generate_series", "SELECT g.v, g.v * g.v AS sq FROM GENERATE_SERIES(1, 1000) AS g (v)", "SELECT v, v * v AS sq FROM generate_series(1, 1000) AS g(v)")
both("generate_series_step", "SELECT n_nationkey, g.v FROM nation, LATERAL GENERATE_SERIES(n_regionkey, n_nationkey, 3) AS g (v)", "SELECT n_nationkey, unnest(range(n_regionkey, n_nationkey + 1, 3)) AS v FROM nation")
both("array_operators", "SELECT n_nationkey, [n_nationkey, ...[1, 2]] AS a, [1, 2] || n_regionkey AS b, [n_regionkey, n_nationkey, 5][-1] AS c, LENGTH([1, 2, n_nationkey]) AS d, [1, n_regionkey] = [1, 2] AS e FROM nation", "SELECT n_nationkey, [n_nationkey, 1, 2] AS a, [1, 2, n_regionkey] AS b, 5 AS c, 3 AS d, n_regionkey = 2 AS e FROM nation")
both("array_subquery", "SELECT r_regionkey, LENGTH(ARRAY (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)) AS n FROM region", "SELECT r_regionkey, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
both("path_extract_props", "SELECT event_id, CAST(props.k AS INTEGER) AS k FROM events WHERE props.k > 50", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) > 50")
both("path_aggregate_props", "SELECT event_type, CAST(SUM(CAST(props.k AS INTEGER)) AS BIGINT) AS s FROM events GROUP BY event_type", "SELECT event_type, CAST(SUM(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY event_type")
both("path_edit", "SELECT event_id, CAST(PATH_EXTRACT(PATH_SET(props, $.a, [user_id]), $.a[0]) AS INTEGER) AS a, TYPEOF(PATH_EXTRACT(PATH_REMOVE(props, $.k), $.k)) AS b, CAST(PATH_EXTRACT(PATH_INSERT(props, $.k, 0), $.k) AS INTEGER) AS c, CAST(PATH_EXTRACT(PATH_REPLACE(props, $.k, 7), $.k) AS INTEGER) AS d FROM events", "SELECT event_id, user_id AS a, 'null' AS b, CAST(props->>'k' AS BIGINT) AS c, 7 AS d FROM events")
both("object_build", "SELECT o.x.key AS k, o.x.name AS nm, OBJECT_KEYS(o.x) AS ks FROM (SELECT {key: n_nationkey, name: n_name} AS x FROM nation) AS o", "SELECT n_nationkey AS k, n_name AS nm, ['key', 'name'] AS ks FROM nation")
both("object_spread_star", "SELECT o.x.r_name AS a, o.x.extra AS b FROM (SELECT {region.*, extra: 1} AS x FROM region) AS o", "SELECT r_name AS a, 1 AS b FROM region")
both("object_patch", "SELECT event_id, CAST(p.x.k AS INTEGER) AS k, CAST(p.x.z AS INTEGER) AS z FROM (SELECT event_id, PATCH(props, {z: user_id, k: NULL}) AS x FROM events) AS p", "SELECT event_id, CAST(NULL AS BIGINT) AS k, user_id AS z FROM events")
both("object_entries", "SELECT o.k, CAST(OBJECT_VALUES(o.x)[1] AS INTEGER) AS v, CAST(OBJECT_ENTRIES(o.x)[0][1] AS INTEGER) AS e, OBJECT_FROM_ENTRIES([['n', o.k], ['m', 1]]).m = 1 AS f FROM (SELECT n_nationkey AS k, {a: n_nationkey, b: n_regionkey} AS x FROM nation) AS o", "SELECT n_nationkey AS k, n_regionkey AS v, n_nationkey AS e, true AS f FROM nation")
both("path_wildcards", "SELECT event_id, LENGTH({p: props, q: [{k: user_id}]}..k) AS n, LENGTH([props, {k: user_id}][*].k) AS u FROM events", "SELECT event_id, 2 AS n, 2 AS u FROM events")
both("match_containment", "SELECT event_id FROM events WHERE props @> {k: 42} OR {k: 43, y: 1} <@ props OR props MATCH {k: 44}", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) IN (42, 44)")
both("whole_document", "SELECT r.x.r_name AS nm FROM (SELECT region AS x FROM region) AS r WHERE r.x @> {r_regionkey: 2}", "SELECT r_name AS nm FROM region WHERE r_regionkey = 2")
both("like_function", "SELECT n_name FROM nation WHERE LIKE('%_1', n_name) AND GLOB('NATION*', n_name) AND BETWEEN(n_nationkey, 1, 21)", "SELECT n_name FROM nation WHERE n_name LIKE '%_1' AND n_name GLOB 'NATION*' AND n_nationkey BETWEEN 1 AND 21")
both("information_schema", "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation')", "SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation')")
both("text_group", "SELECT lang, COUNT(*) AS n, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars FROM documents WHERE text LIKE '%license%' OR source LIKE 'src1%' GROUP BY lang", "SELECT lang, COUNT(*) AS n, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars FROM documents WHERE regexp_matches(text, '^[^\\n]*license[^\\n]*$') OR source LIKE 'src1%' GROUP BY lang")


def session_for(spark: SparkSession, sf_dir: str, path: str | None = None, sqlite_mode: bool = False) -> Session:
    """A session over the tables of a folder."""
    s = Session(spark, path, sqlite_mode)
    for name in TABLES:
        s.register(name, f"{sf_dir}/{name}.parquet", DOCUMENT_COLUMNS.get(name, ()))
    return s


def ask(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    text = spelled(sql, duck=False)
    return lambda spark, sf_dir: session_for(spark, sf_dir).execute(text)


# -- versioned tables: scripts over whole tables

def database_folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files."""
    return f"{shared_folder(spark)}/db-{uuid.uuid4().hex}"


def scripted(*steps: str) -> Callable[[SparkSession, str], DataFrame]:
    """Run statements in turn; ``{name}`` in a later one is the system time after the step of that name ("name: statement")."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session_for(spark, sf_dir, database_folder(spark), sqlite_mode=steps[0].startswith("CREATE TABLE"))
        times: dict[str, str] = {}
        out = None
        for step in steps:
            name, colon, sql = step.partition(": ")
            if not colon or not name.isidentifier():
                name, sql = "", step
            for k, v in times.items():
                sql = sql.replace(f"<{k}>", v)
            out = s.execute(spelled(sql, duck=False))
            if name:
                times[name] = f"TIMESTAMP '{s.last.isoformat()}'"
        return out

    return run


_LOAD = "loaded: INSERT INTO accounts SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey AS nation FROM customer"
_SUM = "SELECT nation, COUNT(*) AS n, @2[SUM(balance)]@ AS total FROM accounts{} GROUP BY nation"

#: name -> (steps, DuckDB text)
SCRIPTS: dict[str, tuple[tuple[str, ...], str]] = {
    "insert_select": ((_LOAD, _SUM.format("")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer GROUP BY c_nationkey"),
    "update_where": ((_LOAD, "UPDATE accounts SET balance = balance + 100.0, flag = TRUE WHERE balance < 0", "SELECT nation, COUNT(flag) AS n, @2[SUM(balance)]@ AS total FROM accounts GROUP BY nation"), "SELECT c_nationkey AS nation, COUNT(CASE WHEN c_acctbal < 0 THEN 1 END) AS n, @2[SUM(c_acctbal + CASE WHEN c_acctbal < 0 THEN 100.0 ELSE 0 END)]@ AS total FROM customer GROUP BY c_nationkey"),
    "update_unset_patch": ((_LOAD, "UPDATE accounts UNSET nation PATCH {kind: 'old', name: NULL} WHERE id % 2 = 0", "SELECT kind, COUNT(*) AS n, COUNT(nation) AS nations, COUNT(name) AS names FROM accounts GROUP BY kind"), "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS kind, COUNT(*) AS n, COUNT(CASE WHEN c_custkey % 2 <> 0 THEN 1 END) AS nations, COUNT(CASE WHEN c_custkey % 2 <> 0 THEN 1 END) AS names FROM customer GROUP BY 1"),
    "delete_where": ((_LOAD, "DELETE FROM accounts WHERE nation < 10", _SUM.format("")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer WHERE c_nationkey >= 10 GROUP BY c_nationkey"),
    "erase_history": ((_LOAD, "DELETE FROM accounts WHERE nation < 10", "ERASE FROM accounts WHERE nation < 5", _SUM.format(" FOR SYSTEM_TIME ALL")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer WHERE c_nationkey >= 5 GROUP BY c_nationkey"),
    "as_of": ((_LOAD, "UPDATE accounts SET balance = 0.0 WHERE nation < 20", "DELETE FROM accounts WHERE nation >= 20", _SUM.format(" FOR SYSTEM_TIME AS OF <loaded>")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer GROUP BY c_nationkey"),
    "between_system_time": (
        (_LOAD, "changed: UPDATE accounts SET balance = 0.0 WHERE nation < 20", "DELETE FROM accounts WHERE nation >= 20", "SELECT nation, COUNT(*) AS n FROM accounts FOR SYSTEM_TIME BETWEEN <loaded> AND <changed> GROUP BY nation"),
        "SELECT c_nationkey AS nation, COUNT(*) * (CASE WHEN c_nationkey < 20 THEN 2 ELSE 1 END) AS n FROM customer GROUP BY c_nationkey",
    ),
    "from_to_system_time": (
        (_LOAD, "changed: UPDATE accounts SET balance = 0.0 WHERE nation < 20", "SELECT nation, COUNT(*) AS n FROM accounts FOR SYSTEM_TIME FROM <loaded> TO <changed> GROUP BY nation"),
        "SELECT c_nationkey AS nation, COUNT(*) AS n FROM customer GROUP BY c_nationkey",
    ),
    "system_time_all": ((_LOAD, "UPDATE accounts SET balance = 0.0 WHERE nation < 20", "SELECT COUNT(*) AS n, COUNT(CASE WHEN system_time.end < CURRENT_TIMESTAMP THEN 1 END) AS ended FROM accounts FOR SYSTEM_TIME ALL"), "SELECT COUNT(*) + COUNT(CASE WHEN c_nationkey < 20 THEN 1 END) AS n, COUNT(CASE WHEN c_nationkey < 20 THEN 1 END) AS ended FROM customer"),
    "upsert": (
        (_LOAD, "INSERT INTO accounts SELECT s_suppkey * 10 AS id, s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier ON CONFLICT (id) DO UPDATE SET balance = balance + excluded.balance, name = excluded.name", "SELECT id, name, @2[balance]@ AS balance, nation FROM accounts"),
        "SELECT coalesce(c_custkey, s_suppkey * 10) AS id, coalesce(s_name, c_name) AS name, @2[coalesce(c_acctbal, 0) + coalesce(s_acctbal, 0)]@ AS balance, coalesce(c_nationkey, s_nationkey) AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 10",
    ),
    "upsert_nothing": (
        (_LOAD, "INSERT INTO accounts SELECT s_suppkey * 100 AS id, s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier ON CONFLICT (id) DO NOTHING", "SELECT id, name FROM accounts"),
        "SELECT coalesce(c_custkey, s_suppkey * 100) AS id, coalesce(c_name, s_name) AS name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 100",
    ),
    "view": ((_LOAD, "CREATE VIEW rich (k, b) AS SELECT id, balance FROM accounts WHERE balance > 9000", "SELECT COUNT(*) AS n, MIN(k) AS k FROM rich"), "SELECT COUNT(*) AS n, MIN(c_custkey) AS k FROM customer WHERE c_acctbal > 9000"),
    "savepoint_rollback": ((_LOAD, "BEGIN", "DELETE FROM accounts WHERE nation = 1", "SAVEPOINT a", "DELETE FROM accounts", "ROLLBACK TO a", "COMMIT", _SUM.format("")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer WHERE c_nationkey <> 1 GROUP BY c_nationkey"),
    "create_table_index": (("CREATE TABLE accounts (id INTEGER PRIMARY KEY, name TEXT, balance REAL, nation INTEGER)", "CREATE INDEX by_nation ON accounts (nation)", _LOAD, "DROP INDEX by_nation", _SUM.format("")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer GROUP BY c_nationkey"),
    "drop_table": (("CREATE TABLE notes (id INTEGER)", _LOAD, "DROP TABLE notes", "SELECT table_name FROM information_schema.tables WHERE table_name IN ('accounts', 'notes')"), "SELECT 'accounts' AS table_name"),
    "assertion": ((_LOAD, "CREATE ASSERTION rich CHECK (NOT EXISTS (SELECT * FROM accounts WHERE balance > 1000000.0))", "UPDATE accounts SET balance = 1.0 WHERE nation = 3", _SUM.format("")), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(CASE WHEN c_nationkey = 3 THEN 1 ELSE c_acctbal END)]@ AS total FROM customer GROUP BY c_nationkey"),
    "multiple_statements": ((_LOAD + "; DELETE FROM accounts WHERE nation = 2; " + _SUM.format(""),), "SELECT c_nationkey AS nation, COUNT(*) AS n, @2[SUM(c_acctbal)]@ AS total FROM customer WHERE c_nationkey <> 2 GROUP BY c_nationkey"),
    "schema_on_read": ((_LOAD, "INSERT INTO accounts (id, tags) VALUES (-1, ['a', 'b'])", "SELECT COUNT(*) AS n, COUNT(name) AS named, MAX(LENGTH(tags)) AS tags FROM accounts"), "SELECT COUNT(*) + 1 AS n, COUNT(c_name) AS named, 2 AS tags FROM customer"),
}



def with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each of many sets of parameters, by name, and then one by number."""
    s = session_for(spark, sf_dir, database_folder(spark))
    s.execute("INSERT INTO picks (nation, label) SELECT n_nationkey, :label FROM nation WHERE n_regionkey = :region", [{"region": r, "label": f"r{r}"} for r in (0, 2, 4)], many=True)
    return s.execute("SELECT nation, label FROM picks WHERE nation > ?", [3])


_PARAMETERS = "SELECT n_nationkey AS nation, 'r' || n_regionkey AS label FROM nation WHERE n_regionkey IN (0, 2, 4) AND n_nationkey > 3"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: ask(sql) for name, (sql, _) in PAIRS.items()} | {name: scripted(*steps) for name, (steps, _) in SCRIPTS.items()} | {"parameters_many": with_parameters}
ORACLES: dict[str, str] = {name: spelled(duck or sql, duck=True) for name, (sql, duck) in PAIRS.items()} | {name: spelled(duck, duck=True) for name, (_, duck) in SCRIPTS.items()} | {"parameters_many": _PARAMETERS}
