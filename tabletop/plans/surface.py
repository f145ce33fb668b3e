"""SQL that users send as text: one query per part of the language, with the text another engine checks it by.

Spark text names tables in braces. Where the engines share the syntax there is one text. Windows and ordered lists run
over results already summed to a bounded size (calendar, flags), never over the raw rows of one key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabletop.operators.query import sql
from tabletop.session import open_tables


@dataclass(frozen=True)
class Statement:
    text: str
    check: str | None = None

    @property
    def tables(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w+)\}", self.text)))

    @property
    def oracle(self) -> str:
        return (self.check or self.text).replace("{", "").replace("}", "")

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return sql(spark, self.text, **open_tables(spark, folder, self.tables))


STATEMENTS: dict[str, Statement] = {
    "d1_projection": Statement(
        """SELECT * EXCEPT (l_tax), l_extendedprice * (1 - l_discount) AS net_price, l_quantity > 25 AS is_bulk
           FROM {lineitem}""",
        """SELECT * EXCLUDE (l_tax), l_extendedprice * (1 - l_discount) AS net_price, l_quantity > 25 AS is_bulk
           FROM lineitem""",
    ),
    "d2_filter": Statement(
        """SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM {orders}
           WHERE (o_orderpriority LIKE '%-HIGH' OR o_orderpriority ILIKE '%low%' AND o_totalprice BETWEEN 1e5 AND 2e5)
             AND o_orderstatus IN ('F', 'P') AND o_orderdate >= DATE '1996-01-01'
             AND o_orderdate IS DISTINCT FROM DATE '1997-05-28'"""
    ),
    "d3_inner_join": Statement(
        """WITH sold AS (
             SELECT l_orderkey, COUNT(*) AS items, SUM(l_extendedprice * (1 - l_discount)) AS revenue
             FROM {lineitem} GROUP BY l_orderkey),
           bought AS (
             SELECT o_custkey, o_orderpriority, SUM(items) AS items, SUM(revenue) AS revenue
             FROM sold JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderpriority)
           SELECT n_name, o_orderpriority, CAST(SUM(items) AS BIGINT) AS items, ROUND(SUM(revenue), 4) AS revenue
           FROM bought JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
           GROUP BY n_name, o_orderpriority"""
    ),
    "d4_left_join": Statement(
        """WITH bought AS (
             SELECT o_custkey, COUNT(*) AS orders_placed, MAX(o_orderdate) AS last_order
             FROM {orders} GROUP BY o_custkey)
           SELECT c_custkey, c_name, COALESCE(orders_placed, 0) AS orders_placed, last_order
           FROM {customer} LEFT JOIN bought ON c_custkey = o_custkey"""
    ),
    "d4_right_join": Statement(
        """WITH sold AS (
             SELECT l_partkey, SUM(l_quantity) AS quantity FROM {lineitem}
             WHERE l_returnflag = 'R' GROUP BY l_partkey)
           SELECT p_partkey, p_brand, quantity FROM sold RIGHT JOIN {part} ON l_partkey = p_partkey"""
    ),
    "d4_full_join": Statement(
        """WITH placed AS (SELECT o_orderdate AS day, COUNT(*) AS orders_placed FROM {orders} GROUP BY o_orderdate),
                shipped AS (SELECT l_shipdate AS day, COUNT(*) AS items_shipped FROM {lineitem} GROUP BY l_shipdate)
           SELECT COALESCE(placed.day, shipped.day) AS day, orders_placed, items_shipped
           FROM placed FULL JOIN shipped ON placed.day = shipped.day"""
    ),
    "d5_semi_join": Statement(
        """SELECT c_custkey, c_mktsegment FROM {customer}
           WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') u
                         WHERE u.o_custkey = c_custkey)
             AND c_custkey IN (SELECT DISTINCT user_id FROM {events})"""
    ),
    "d5_anti_join": Statement(
        """SELECT p_partkey, p_name FROM {part}
           WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey FROM {lineitem} WHERE l_quantity >= 45) big
                             WHERE big.l_partkey = p_partkey)"""
    ),
    # The joined side is a single row by construction.
    "d6_cross_join": Statement(
        """WITH flags AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS items FROM {lineitem} GROUP BY 1, 2),
                whole AS (SELECT CAST(SUM(items) AS BIGINT) AS total FROM flags)
           SELECT l_returnflag, l_linestatus, items, total, ROUND(CAST(100 * items AS DOUBLE) / total, 3) AS percent
           FROM flags CROSS JOIN whole"""
    ),
    # The joined side has one row per region.
    "d6_theta_join": Statement(
        """WITH usual AS (
             SELECT r_name, AVG(c_acctbal) AS balance FROM {customer}
             JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name)
           SELECT c_mktsegment, r_name, COUNT(*) AS customers_above
           FROM {customer} JOIN usual ON c_acctbal > balance GROUP BY c_mktsegment, r_name"""
    ),
    "d9_correlated_subquery": Statement(
        """SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} o
           WHERE o_totalprice > 1.5 * (SELECT AVG(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)"""
    ),
    "d9_lateral": Statement(
        """SELECT c_custkey, found.orders_placed, found.largest
           FROM {customer}, LATERAL (SELECT COUNT(*) AS orders_placed, MAX(o_totalprice) AS largest
                                     FROM {orders} WHERE o_custkey = c_custkey) AS found"""
    ),
    "d10_group_by": Statement(
        """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price,
                  ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
                  ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 5) AS sum_charge,
                  ROUND(AVG(l_discount), 8) AS avg_disc, COUNT(*) AS count_order
           FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"""
    ),
    "d10_filter_having": Statement(
        """SELECT l_suppkey, COUNT(*) AS items, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
                  SUM(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_quantity,
                  MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
           FROM {lineitem} GROUP BY l_suppkey HAVING COUNT(*) > 20"""
    ),
    "d11_distinct": Statement("""SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM {lineitem}"""),
    "d11_count_distinct": Statement(
        """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts,
                  COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag"""
    ),
    "d11_approximate_distinct": Statement(
        # In one aggregation with the exact count, every different key would carry a sketch of its own.
        """WITH estimated AS (
             SELECT l_returnflag, APPROX_COUNT_DISTINCT(l_orderkey, 0.02) AS near FROM {lineitem} GROUP BY l_returnflag),
           counted AS (
             SELECT l_returnflag AS flag, COUNT(DISTINCT l_orderkey) AS orders FROM {lineitem} GROUP BY l_returnflag)
           SELECT l_returnflag, ABS(near - orders) <= 0.1 * orders AS is_near
           FROM estimated JOIN counted ON l_returnflag IS NOT DISTINCT FROM flag""",
        """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) > 0 AS is_near FROM lineitem GROUP BY l_returnflag""",
    ),
    "d12_rollup": Statement(
        """WITH counted AS (
             SELECT c_nationkey, c_mktsegment, COUNT(*) AS customers, SUM(c_acctbal) AS balance
             FROM {customer} GROUP BY c_nationkey, c_mktsegment)
           SELECT n_regionkey, n_name, c_mktsegment, CAST(SUM(customers) AS BIGINT) AS customers,
                  ROUND(SUM(balance), 2) AS balance
           FROM counted JOIN {nation} ON c_nationkey = n_nationkey
           GROUP BY ROLLUP (n_regionkey, n_name, c_mktsegment)"""
    ),
    "d12_cube": Statement(
        """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders,
                  CAST(GROUPING(o_orderstatus) AS INT) AS all_status, CAST(GROUPING(o_orderpriority) AS INT) AS all_prio
           FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
    ),
    "d12_grouping_sets": Statement(
        """SELECT l_returnflag, l_linestatus, CAST(YEAR(l_shipdate) AS BIGINT) AS y, SUM(l_quantity) AS quantity
           FROM {lineitem}
           GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (YEAR(l_shipdate)), ())"""
    ),
    # Quantities and discounts take few values, so the value counts that a percentile keeps per group stay small.
    "d13_percentiles": Statement(
        """SELECT l_returnflag, CAST(MEDIAN(l_quantity) AS DOUBLE) AS median_quantity,
                  PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90_quantity,
                  PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY l_discount) AS p25_discount,
                  PERCENTILE_DISC(0.75) WITHIN GROUP (ORDER BY l_quantity) AS p75_quantity
           FROM {lineitem} GROUP BY l_returnflag"""
    ),
    "d14_string_agg": Statement(
        """WITH pairs AS (
             SELECT c_mktsegment, n_name, customers
             FROM (SELECT c_mktsegment, c_nationkey, COUNT(*) AS customers FROM {customer} GROUP BY 1, 2)
             JOIN {nation} ON c_nationkey = n_nationkey)
           SELECT c_mktsegment, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS nations,
                  STRING_AGG(CAST(customers AS STRING), '+') WITHIN GROUP (ORDER BY customers DESC, n_name) AS counts
           FROM pairs GROUP BY c_mktsegment""",
        """WITH pairs AS (
             SELECT c_mktsegment, n_name, COUNT(*) AS customers FROM customer
             JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name)
           SELECT c_mktsegment, STRING_AGG(n_name, '|' ORDER BY n_name) AS nations,
                  STRING_AGG(CAST(customers AS VARCHAR), '+' ORDER BY customers DESC, n_name) AS counts
           FROM pairs GROUP BY c_mktsegment""",
    ),
    "d15_ranking_windows": Statement(
        """WITH monthly AS (
             SELECT l_returnflag, YEAR(l_shipdate) * 100 + MONTH(l_shipdate) AS m, COUNT(*) AS items
             FROM {lineitem} GROUP BY 1, 2)
           SELECT l_returnflag, CAST(m AS BIGINT) AS m, items,
                  CAST(ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY items DESC, m) AS BIGINT) AS row_no,
                  CAST(RANK() OVER w AS BIGINT) AS rank_no, CAST(DENSE_RANK() OVER w AS BIGINT) AS dense_no,
                  CAST(NTILE(4) OVER (PARTITION BY l_returnflag ORDER BY items DESC, m) AS BIGINT) AS quarter,
                  ROUND(PERCENT_RANK() OVER w, 9) AS percent_rank, ROUND(CUME_DIST() OVER w, 9) AS cume_dist
           FROM monthly WINDOW w AS (PARTITION BY l_returnflag ORDER BY items DESC)"""
    ),
    "d16_analytic_windows": Statement(
        """WITH monthly AS (
             SELECT o_orderpriority, YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS m, COUNT(*) AS orders
             FROM {orders} GROUP BY 1, 2)
           SELECT o_orderpriority, CAST(m AS BIGINT) AS m, orders,
                  LAG(orders, 1) OVER w AS before, LEAD(orders, 2, CAST(-1 AS BIGINT)) OVER w AS after_two,
                  FIRST_VALUE(orders) OVER w AS first_orders, LAST_VALUE(orders) OVER whole AS last_orders,
                  NTH_VALUE(orders, 3) OVER whole AS third_orders
           FROM monthly
           WINDOW w AS (PARTITION BY o_orderpriority ORDER BY m),
                  whole AS (PARTITION BY o_orderpriority ORDER BY m
                            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    ),
    "d17_window_frames": Statement(
        """WITH daily AS (
             SELECT o_orderstatus, o_orderdate, COUNT(*) AS orders, SUM(o_totalprice) AS price
             FROM {orders} GROUP BY o_orderstatus, o_orderdate)
           SELECT o_orderstatus, o_orderdate, orders,
                  CAST(SUM(orders) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate
                                         ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_rows,
                  CAST(SUM(orders) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate
                                         RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS month,
                  ROUND(MAX(price) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate
                                         ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 2) AS best_ahead
           FROM daily"""
    ),
    "d18_qualify": Statement(
        """SELECT o_custkey, o_orderkey, o_totalprice FROM (
             SELECT o_custkey, o_orderkey, o_totalprice,
                    ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
             FROM {orders}) WHERE place <= 3""",
        """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
           QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""",
    ),
    "d19_top_k": Statement(
        """SELECT o_orderkey, o_totalprice, o_orderdate FROM {orders}
           ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10"""
    ),
    "d20_union": Statement(
        """SELECT c_nationkey AS nationkey, 'customer' AS kind, c_acctbal AS balance FROM {customer}
           UNION ALL SELECT s_nationkey, 'supplier', s_acctbal FROM {supplier}"""
    ),
    "d20_union_distinct": Statement(
        """SELECT o_custkey AS person FROM {orders} UNION SELECT user_id FROM {events}"""
    ),
    "d20_intersect": Statement(
        """SELECT l_partkey AS k, l_suppkey AS s FROM {lineitem} WHERE l_returnflag = 'A'
           INTERSECT SELECT l_partkey, l_suppkey FROM {lineitem} WHERE l_returnflag = 'R'"""
    ),
    "d20_intersect_all": Statement(
        """SELECT person, COUNT(*) AS copies FROM (
             SELECT o_custkey AS person FROM {orders} INTERSECT ALL SELECT user_id FROM {events}) GROUP BY person"""
    ),
    "d20_except": Statement("""SELECT o_custkey FROM {orders} EXCEPT SELECT user_id FROM {events}"""),
    "d20_except_all": Statement(
        """SELECT person, COUNT(*) AS copies FROM (
             SELECT o_custkey AS person FROM {orders} EXCEPT ALL SELECT user_id FROM {events}) GROUP BY person"""
    ),
    # Recursion runs over the years between the first and the last order.
    "d21_recursive_cte": Statement(
        """WITH RECURSIVE span AS (
             SELECT CAST(MIN(YEAR(o_orderdate)) AS INT) AS low, CAST(MAX(YEAR(o_orderdate)) AS INT) AS high
             FROM {orders}),
           years AS (SELECT low AS y, high FROM span UNION ALL SELECT y + 1, high FROM years WHERE y < high),
           placed AS (SELECT CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS orders FROM {orders} GROUP BY 1)
           SELECT years.y, COALESCE(orders, 0) AS orders FROM years LEFT JOIN placed ON years.y = placed.y"""
    ),
    "d22_pivot": Statement(
        """SELECT y, open_orders, finished_orders, pending_orders
           FROM (SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y, o_orderstatus, o_orderkey FROM {orders})
           PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN
                  ('O' AS open_orders, 'F' AS finished_orders, 'P' AS pending_orders))""",
        """SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y,
                  COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders,
                  COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished_orders,
                  COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS pending_orders FROM orders GROUP BY 1""",
    ),
    "d22_unpivot": Statement(
        """SELECT l_orderkey, l_linenumber, l_partkey, measure, amount
           FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM {lineitem})
           UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax))"""
    ),
    "d23_values": Statement(
        """WITH counted AS (
             SELECT o_orderstatus, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS price
             FROM {orders} GROUP BY o_orderstatus)
           SELECT label, orders, price
           FROM counted JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) AS names(code, label)
             ON o_orderstatus = code"""
    ),
    "d24_string_functions": Statement(
        """SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS chars, MD5(text) AS digest, UPPER(lang) AS lang,
                  SUBSTRING(text, 3, 20) AS part,
                  CAST(LENGTH(REGEXP_REPLACE(text, '[0-9]+', '#')) AS BIGINT) AS masked_chars,
                  CONCAT_WS('/', lang, source, CAST(doc_id AS STRING)) AS path,
                  LPAD(CAST(doc_id AS STRING), 8, '0') AS padded, REPLACE(source, 'src', 'origin-') AS origin,
                  SPLIT_PART(source, 'c', 2) AS source_no, STARTSWITH(text, 'T') AS starts_t,
                  CAST(LENGTH(text) - LENGTH(REPLACE(text, 'e', '')) AS BIGINT) AS letters_e, TRIM(SUBSTRING(text, 1, 5)) AS head
           FROM {documents}""",
        """SELECT doc_id, LENGTH(text) AS chars, MD5(text) AS digest, UPPER(lang) AS lang, SUBSTRING(text, 3, 20) AS part,
                  LENGTH(REGEXP_REPLACE(text, '[0-9]+', '#', 'g')) AS masked_chars,
                  CONCAT_WS('/', lang, source, CAST(doc_id AS VARCHAR)) AS path,
                  LPAD(CAST(doc_id AS VARCHAR), 8, '0') AS padded, REPLACE(source, 'src', 'origin-') AS origin,
                  SPLIT_PART(source, 'c', 2) AS source_no, STARTS_WITH(text, 'T') AS starts_t,
                  LENGTH(text) - LENGTH(REPLACE(text, 'e', '')) AS letters_e, TRIM(SUBSTRING(text, 1, 5)) AS head
           FROM documents""",
    ),
    "d25_date_functions": Statement(
        """SELECT o_orderkey, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS quarter_start,
                  CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS w,
                  CAST(WEEKDAY(o_orderdate) + 1 AS BIGINT) AS iso_weekday,
                  CAST(DATEDIFF(o_orderdate, DATE '1995-01-01') AS BIGINT) AS day_no,
                  DATE_ADD(CAST(o_orderdate AS DATE), 45) AS due, LAST_DAY(CAST(o_orderdate AS DATE)) AS month_end,
                  DATE_FORMAT(o_orderdate, 'yyyy/MM/dd') AS shown, o_orderdate + INTERVAL '36' HOUR AS later
           FROM {orders}""",
        """SELECT o_orderkey, CAST(DATE_TRUNC('quarter', o_orderdate) AS DATE) AS quarter_start,
                  CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(WEEK FROM o_orderdate) AS BIGINT) AS w,
                  CAST(ISODOW(o_orderdate) AS BIGINT) AS iso_weekday,
                  CAST(DATE_DIFF('day', DATE '1995-01-01', o_orderdate) AS BIGINT) AS day_no,
                  CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) AS due, LAST_DAY(CAST(o_orderdate AS DATE)) AS month_end,
                  STRFTIME(o_orderdate, '%Y/%m/%d') AS shown, o_orderdate + INTERVAL '36' HOUR AS later
           FROM orders""",
    ),
    "d26_math_functions": Statement(
        """SELECT l_orderkey, l_partkey, l_linenumber, l_orderkey DIV 7 AS whole_sevenths, l_orderkey % 7 AS rest,
                  l_linenumber / 2 AS half, CAST(FLOOR(l_extendedprice) AS BIGINT) AS floored,
                  CAST(CEIL(l_extendedprice) AS BIGINT) AS ceiled, SQRT(l_extendedprice) AS root,
                  ABS(l_quantity - 25) AS off, CAST(SIGN(l_quantity - 25) AS INT) AS side,
                  ROUND(LN(l_extendedprice), 6) AS logarithm, POWER(l_quantity, 2) AS square,
                  GREATEST(l_discount, l_tax) AS higher, LEAST(l_discount, l_tax) AS lower
           FROM {lineitem}""",
        """SELECT l_orderkey, l_partkey, l_linenumber, l_orderkey // 7 AS whole_sevenths, l_orderkey % 7 AS rest,
                  l_linenumber / 2 AS half, CAST(FLOOR(l_extendedprice) AS BIGINT) AS floored,
                  CAST(CEIL(l_extendedprice) AS BIGINT) AS ceiled, SQRT(l_extendedprice) AS root,
                  ABS(l_quantity - 25) AS off, CAST(SIGN(l_quantity - 25) AS INT) AS side,
                  ROUND(LN(l_extendedprice), 6) AS logarithm, POWER(l_quantity, 2) AS square,
                  GREATEST(l_discount, l_tax) AS higher, LEAST(l_discount, l_tax) AS lower
           FROM lineitem""",
    ),
    "d27_casts": Statement(
        """SELECT o_orderkey, CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS priority,
                  TRY_CAST(o_orderpriority AS INT) AS not_a_number, o_orderkey::STRING AS key_text,
                  CAST(FLOOR(o_totalprice) AS INT) AS price, CAST(o_orderdate AS DATE) AS day,
                  CAST(o_orderdate AS STRING) AS moment, o_orderstatus = 'F' AS done,
                  CAST(o_orderkey AS DOUBLE) AS key_double
           FROM {orders}""",
        """SELECT o_orderkey, CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS priority,
                  TRY_CAST(o_orderpriority AS INT) AS not_a_number, o_orderkey::VARCHAR AS key_text,
                  CAST(FLOOR(o_totalprice) AS INT) AS price, CAST(o_orderdate AS DATE) AS day,
                  CAST(o_orderdate AS VARCHAR) AS moment, o_orderstatus = 'F' AS done,
                  CAST(o_orderkey AS DOUBLE) AS key_double
           FROM orders""",
    ),
    "d28_conditionals": Statement(
        """SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS band,
                  CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 END AS code,
                  COALESCE(NULLIF(event_type, 'view'), 'seen') AS kind, IF(user_id > 75, 'b', 'a') AS half,
                  NULLIF(event_type, 'error') IS NULL AS is_error
           FROM {events}"""
    ),
    "d29_array_functions": Statement(
        """SELECT vec_id, SIZE(embedding) AS width, ELEMENT_AT(embedding, 1) AS first_value,
                  ARRAY_MAX(embedding) AS high, ARRAY_MIN(embedding) AS low,
                  ROUND(AGGREGATE(embedding, CAST(0 AS DOUBLE), (total, x) -> total + CAST(x AS DOUBLE) * x), 6) AS norm,
                  SIZE(FILTER(embedding, x -> x > 0)) AS positives,
                  ARRAY_POSITION(embedding, ARRAY_MAX(embedding)) AS peak,
                  ROUND(CAST(ELEMENT_AT(SORT_ARRAY(embedding), 32) AS DOUBLE), 6) AS middle
           FROM {embeddings}""",
        """SELECT vec_id, CAST(LEN(embedding) AS INT) AS width, embedding[1] AS first_value,
                  LIST_MAX(embedding) AS high, LIST_MIN(embedding) AS low,
                  ROUND(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm,
                  CAST(LEN(LIST_FILTER(embedding, lambda x: x > 0)) AS INT) AS positives,
                  CAST(LIST_POSITION(embedding, LIST_MAX(embedding)) AS BIGINT) AS peak,
                  ROUND(CAST(LIST_SORT(embedding)[32] AS DOUBLE), 6) AS middle
           FROM embeddings""",
    ),
    "d29_unnest": Statement(
        """SELECT label, dimension, COUNT(*) AS vectors, ROUND(AVG(CAST(x AS DOUBLE)), 7) AS mean
           FROM {embeddings}, LATERAL POSEXPLODE(embedding) AS e(dimension, x) GROUP BY label, dimension""",
        """SELECT label, CAST(dimension - 1 AS INT) AS dimension, COUNT(*) AS vectors, ROUND(AVG(CAST(x AS DOUBLE)), 7) AS mean
           FROM (SELECT label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS dimension FROM embeddings)
           GROUP BY label, dimension""",
    ),
    "d30_struct_map": Statement(
        """WITH counted AS (
             SELECT user_id, event_type, COUNT(*) AS n, MAX(value) AS top FROM {events} GROUP BY user_id, event_type),
           folded AS (
             SELECT user_id, MAP_FROM_ENTRIES(COLLECT_LIST(STRUCT(event_type, STRUCT(n, top)))) AS by_type
             FROM counted GROUP BY user_id)
           SELECT user_id, SIZE(by_type) AS kinds, by_type['click'].n AS clicks, by_type['purchase'].top AS top_purchase,
                  SIZE(MAP_FILTER(by_type, (kind, facts) -> facts.n > 10)) AS busy_kinds,
                  ARRAY_JOIN(ARRAY_SORT(MAP_KEYS(by_type)), ',') AS names
           FROM folded""",
        """SELECT user_id, CAST(COUNT(*) AS INT) AS kinds, MAX(n) FILTER (WHERE event_type = 'click') AS clicks,
                  MAX(top) FILTER (WHERE event_type = 'purchase') AS top_purchase,
                  CAST(COUNT(*) FILTER (WHERE n > 10) AS INT) AS busy_kinds,
                  STRING_AGG(event_type, ',' ORDER BY event_type) AS names
           FROM (SELECT user_id, event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY user_id, event_type)
           GROUP BY user_id""",
    ),
    "d31_json_functions": Statement(
        """SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS INT) AS k,
                  FROM_JSON(props, 'k INT').k * 2 AS twice, VARIANT_GET(PARSE_JSON(props), '$.k', 'bigint') AS k_long,
                  TRY_VARIANT_GET(PARSE_JSON(props), '$.missing', 'string') AS missing,
                  JSON_OBJECT_KEYS(props)[0] AS first_key,
                  SCHEMA_OF_VARIANT(VARIANT_GET(PARSE_JSON(props), '$.k')) = 'BIGINT' AS is_int
           FROM {events}""",
        """SELECT event_id, CAST(JSON_EXTRACT_STRING(props, '$.k') AS INT) AS k,
                  CAST(JSON_EXTRACT(props, '$.k') AS INT) * 2 AS twice, CAST(JSON_EXTRACT(props, '$.k') AS BIGINT) AS k_long,
                  JSON_EXTRACT_STRING(props, '$.missing') AS missing, JSON_KEYS(props)[1] AS first_key,
                  JSON_TYPE(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_int
           FROM events""",
    ),
}

# Which rows a sample holds is the engine's choice, so there is no text to check it by.
SAMPLES: dict[str, Statement] = {
    "d23_tablesample": Statement(
        "SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} TABLESAMPLE (10 PERCENT) REPEATABLE (7)"
    ),
}
