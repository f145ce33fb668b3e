"""Registered queries for SQL text, previews, statements, special joins and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.operators.dominance import overlap_counts, theta_sums
from tabletop.operators.export import export_csv
from tabletop.operators.joins import asof_join, range_join
from tabletop.operators.ordered import group_sample, with_global_ranks
from tabletop.operators.overlaps import overlap_join
from tabletop.operators.query import execute, preview, preview_frame, rows_as_json, sql
from tabletop.operators.reach import reachable
from tabletop.operators.selection import exact_percentiles
from tabletop.operators.snapshots import read_snapshot, write_snapshot
from tabletop.operators.transcripts import assemble, last_messages, split_reply, token_rate
from tabletop.operators.upserts import delete_keys, upsert
from tabletop.plans.register import registered
from tabletop.plans.tables import table
from tabletop.plans.transfer import new_database
from tabletop.session import open_tables, working_folder
from tabletop.sources.files import read_csv, read_json

SALES_PER_NATION = """
    WITH sold AS (
      SELECT l_orderkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM {lineitem} GROUP BY l_orderkey),
    bought AS (
      SELECT o_custkey, COUNT(*) AS orders, SUM(revenue) AS revenue
      FROM sold JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT n_name, CAST(SUM(orders) AS BIGINT) AS orders, ROUND(SUM(revenue), 4) AS revenue
    FROM bought JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    GROUP BY n_name ORDER BY revenue DESC, n_name"""


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Text → result → snapshot of the whole result → read back."""
    frames = open_tables(spark, folder, ["lineitem", "orders", "customer", "nation"])
    result = sql(spark, SALES_PER_NATION, **frames)
    root = working_folder(spark, "snapshots")
    write_snapshot(result, root, "sales-per-nation")
    return read_snapshot(spark, root, "sales-per-nation")


def _plain(text: str) -> str:
    return text.replace("{", "").replace("}", "")


@registered("q1_sql", _plain(SALES_PER_NATION))
def sales_per_nation(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)


@registered(
    "q1_sql_over_result",
    """SELECT o_orderstatus, priority, orders * 2 AS twice FROM (
         SELECT o_orderstatus, SUBSTRING(o_orderpriority, 1, 1) AS priority, COUNT(*) AS orders FROM orders GROUP BY ALL)
       WHERE orders > 10""",
)
def query_over_result(spark: SparkSession, folder: str) -> DataFrame:
    """A second query names the result of the first."""
    first = sql(
        spark,
        """SELECT o_orderstatus, SUBSTRING(o_orderpriority, 1, 1) AS priority, COUNT(*) AS orders
           FROM {orders} GROUP BY ALL;""",
        orders=table(spark, folder, "orders"),
    )
    return sql(spark, "SELECT o_orderstatus, priority, orders * 2 AS twice FROM {first} WHERE orders > 10", first=first)


@registered(
    "q2_preview",
    """SELECT *, (SELECT COUNT(*) FROM lineitem WHERE l_quantity > 40) AS total_rows,
              LEAST((SELECT COUNT(*) FROM lineitem WHERE l_quantity > 40), 100) AS preview_count
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_quantity > 40
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100)""",
)
def previewed(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    items = table(spark, folder, "lineitem").where("l_quantity > 40").select(columns)
    return preview_frame(items.orderBy(columns))


@registered(
    "q3_execute",
    """SELECT o_orderstatus, COUNT(*) + COUNT(*) FILTER (WHERE o_totalprice > 200000) AS orders,
              'Query executed successfully' AS "Message" FROM orders GROUP BY o_orderstatus""",
)
def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements without rows answer with a message; the query at the end sees what they did."""
    orders = table(spark, folder, "orders")
    name = f"{new_database(spark)}.placed"
    execute(spark, f"CREATE TABLE {name} (o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE) USING parquet")
    for condition in ("true", "o_totalprice > 200000"):
        said = execute(
            spark,
            f"INSERT INTO {name} SELECT o_orderkey, o_orderstatus, o_totalprice FROM {{orders}} WHERE {condition}",
            orders=orders,
        )
    counted = execute(spark, f"SELECT o_orderstatus, COUNT(*) AS orders FROM {name} GROUP BY o_orderstatus")
    return counted.withColumn("Message", said.scalar())


@registered(
    "d32_ddl_dml",
    """SELECT c_nationkey, COUNT(*) AS customers, MAX(c_acctbal) AS best FROM customer GROUP BY c_nationkey
       UNION ALL SELECT s_nationkey, COUNT(*), MAX(s_acctbal) FROM supplier GROUP BY s_nationkey""",
)
def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Create from a query, append, and drop: an external table keeps its files."""
    frames = open_tables(spark, folder, ["customer", "supplier"])
    database, path = new_database(spark), working_folder(spark, "people")
    execute(
        spark,
        f"CREATE TABLE {database}.people USING parquet LOCATION '{path}' AS SELECT c_nationkey, COUNT(*) AS customers, "
        "MAX(c_acctbal) AS best FROM {customer} GROUP BY c_nationkey",
        **frames,
    )
    execute(
        spark,
        f"INSERT INTO {database}.people SELECT s_nationkey, COUNT(*), MAX(s_acctbal) "
        "FROM {supplier} GROUP BY s_nationkey",
        **frames,
    )
    execute(spark, f"DROP TABLE {database}.people")
    return spark.read.parquet(path)


@registered(
    "q4_rows_as_json",
    """SELECT TO_JSON({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice,
                       'o_orderdate': CAST(o_orderdate AS VARCHAR), 'o_orderpriority': o_orderpriority,
                       'urgent': NULLIF(o_orderpriority, '5-LOW')})::VARCHAR AS json
       FROM orders""",
)
def json_objects(spark: SparkSession, folder: str) -> DataFrame:
    urgent = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("urgent")
    orders = table(spark, folder, "orders")
    return rows_as_json(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", urgent))


@registered(
    "q5_cross_source_join",
    """SELECT c_mktsegment, o_orderpriority, COUNT(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY ALL""",
)
def across_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Customers from CSV and orders from JSON lines in one statement."""
    customers, orders = working_folder(spark, "customers"), working_folder(spark, "orders")
    export_csv(table(spark, folder, "customer"), customers)
    rows_as_json(table(spark, folder, "orders")).withColumnRenamed("json", "value").write.text(orders)
    return sql(
        spark,
        """WITH placed AS (SELECT o_custkey, o_orderpriority, COUNT(*) AS orders FROM {orders} GROUP BY ALL)
           SELECT c_mktsegment, o_orderpriority, SUM(orders) AS orders
           FROM placed JOIN {customer} ON o_custkey = CAST(c_custkey AS BIGINT) GROUP BY ALL""",
        customer=read_csv(spark, customers),
        orders=read_json(spark, orders),
    )


@registered(
    "d6_theta_rows",
    """SELECT o_orderpriority, COUNT(*) AS pairs, COUNT(DISTINCT o_orderkey) AS orders, MAX(l_shipdate) AS last_shipped,
              MAX(l_extendedprice - o_totalprice) AS most
       FROM lineitem JOIN orders ON l_shipdate < o_orderdate - INTERVAL '6' YEAR AND l_extendedprice >= o_totalprice GROUP BY 1""",
)
def dearer_items_of_old(spark: SparkSession, folder: str) -> DataFrame:
    """Raw items shipped six years before an order and not cheaper than all of it, by the order's priority."""
    items = table(spark, folder, "lineitem").select("l_shipdate", "l_extendedprice")
    former = (F.col("o_orderdate") - F.expr("INTERVAL '6' YEAR")).alias("former")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", former)
    met = theta_sums(
        items, orders, ("l_shipdate", "<", "former"), ("l_extendedprice", ">=", "o_totalprice"), ["l_shipdate", "l_extendedprice"])
    # The greatest difference of an order is that with its dearest item.
    return met.groupBy("o_orderpriority").agg(
        F.sum("matches").alias("pairs"), F.countDistinct("o_orderkey").alias("orders"), F.max("most_l_shipdate").alias("last_shipped"),
        F.max(F.col("most_l_extendedprice") - F.col("o_totalprice")).alias("most"))


@registered(
    "d7_range_join",
    """WITH sale AS (SELECT DATE_TRUNC('month', o_orderdate) AS month, MIN(o_orderdate) AS opens,
                            MIN(o_orderdate) + INTERVAL '45' DAY AS closes FROM orders GROUP BY 1)
       SELECT CAST(month AS DATE) AS month, COUNT(*) AS items, SUM(l_quantity) AS quantity
       FROM lineitem JOIN sale ON l_shipdate >= opens AND l_shipdate < closes GROUP BY 1""",
)
def items_in_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Items shipped within 45 days of the first order of each month; the windows overlap."""
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    sales = table(spark, folder, "orders").groupBy(month).agg(F.min("o_orderdate").alias("opens"))
    sales = sales.withColumn("closes", F.col("opens") + F.expr("INTERVAL '45' DAY"))
    items = table(spark, folder, "lineitem").select("l_shipdate", "l_quantity")
    joined = range_join(items, sales, "l_shipdate", "opens", "closes", grain="day")
    return joined.groupBy("month").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"))


@registered(
    "d7_overlap_join",
    """WITH spans AS (
         SELECT l_orderkey, MIN(l_shipdate) AS opens, MAX(l_shipdate) + INTERVAL '1' DAY AS closes FROM lineitem GROUP BY 1),
       held AS (SELECT o_custkey, o_orderkey, opens, closes FROM spans JOIN orders ON o_orderkey = l_orderkey)
       SELECT a.o_custkey AS customer, COUNT(*) AS pairs, MIN(GREATEST(a.opens, b.opens)) AS first_met
       FROM held a JOIN held b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opens < b.closes AND b.opens < a.closes
       GROUP BY 1""",
)
def orders_under_way_together(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of orders of one customer that are shipped in overlapping spans of days, for each customer."""
    spans = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("opens"), (F.max("l_shipdate") + F.expr("INTERVAL '1' DAY")).alias("closes"))
    path = working_folder(spark, "spans")
    spans.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").write.parquet(path)
    held = spark.read.parquet(path)
    other = held.select([F.col(name).alias(f"other_{name}") for name in held.columns])
    met = overlap_join(held, other, ("opens", "closes"), ("other_opens", "other_closes"), 30 * 86400, [("o_custkey", "other_o_custkey")])
    met = met.where("o_orderkey < other_o_orderkey")
    return met.groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count("*").alias("pairs"), F.min(F.greatest("opens", "other_opens")).alias("first_met"))


@registered(
    "d7_overlap_join_numbers",
    """SELECT p_brand, COUNT(*) AS pairs, COUNT(DISTINCT s_suppkey) AS suppliers
       FROM part JOIN supplier ON p_retailprice < s_acctbal + 2000 AND s_acctbal < p_retailprice + p_size GROUP BY 1""",
)
def parts_in_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of prices that meet ranges of balances: intervals of numbers on both sides."""
    parts = table(spark, folder, "part").select("p_brand", "p_retailprice", (F.col("p_retailprice") + F.col("p_size")).alias("p_most"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 2000).alias("s_most"))
    met = overlap_counts(parts, suppliers, ("p_retailprice", "p_most"), ("s_acctbal", "s_most"), "p_brand")
    return met.groupBy("p_brand").agg(F.sum("matches").alias("pairs"), F.countDistinct("s_suppkey").alias("suppliers"))


@registered(
    "d8_asof_join",
    """WITH bought AS (
         SELECT user_id, ts, MAX(event_id) AS purchase_id, ARG_MAX(value, event_id) AS price
         FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
       SELECT e.event_id, e.user_id, e.ts, b.purchase_id, b.price
       FROM events e ASOF LEFT JOIN bought b ON e.user_id = b.user_id AND e.ts >= b.ts""",
)
def latest_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the latest purchase of its user up to then."""
    events = table(spark, folder, "events")
    bought = events.where("event_type = 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("price")
    )
    return asof_join(
        events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "ts", ["purchase_id", "price"], grain="hour"
    )


_LAST = """SELECT * FROM conversations
           QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}"""


@registered("t1_last_messages", _LAST.format(n=20))
def histories(spark: SparkSession, folder: str) -> DataFrame:
    return last_messages(table(spark, folder, "conversations"))


@registered("t1_last_four_messages", _LAST.format(n=4))
def short_histories(spark: SparkSession, folder: str) -> DataFrame:
    return last_messages(table(spark, folder, "conversations"), 4)


@registered(
    "t2_split_reply",
    r"""SELECT conv_id, turn,
               CASE WHEN role = 'user' THEN NULL
                    ELSE REGEXP_REPLACE(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') END AS query,
               CASE WHEN role = 'system' THEN NULL
                    ELSE REGEXP_REPLACE(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') || '!' END AS comment
        FROM conversations""",
)
def reply_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Replies built from messages: comment only, query left open, or both parts."""
    trimmed = F.trim("text", F.lit(" \t\r\n"))
    query = F.concat(F.lit("<query>\n"), trimmed, F.lit(" </query>"))
    comment = F.concat(F.lit("<comment>"), trimmed, F.lit("!</comment>"))
    reply = (
        F.when(F.col("role") == "user", comment)
        .when(F.col("role") == "system", F.concat(F.lit("<query>"), trimmed))
        .otherwise(F.concat(query, comment))
    )
    replies = table(spark, folder, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return split_reply(replies, "reply").select("conv_id", "turn", "query", "comment")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every message cut into words with the blanks after them, numbered from 0."""
    words = F.regexp_extract_all("text", F.lit(r"\S+\s*|\s+"), F.lit(0))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(words).alias("seq", "token"))


@registered("t3_assemble", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of 50 chunks, so that longer messages are put together from several."""
    return assemble(_chunks(spark, folder), ["conv_id", "turn"], chunks_per_piece=50)


@registered(
    "t4_token_rate",
    """SELECT user_id, tokens_generated, ROUND(s, 2) AS time_seconds,
              CASE WHEN s > 0 THEN ROUND(tokens_generated / s, 1) ELSE tokens_generated::DOUBLE END AS tokens_per_second
       FROM (SELECT user_id, COUNT(*) AS tokens_generated,
                    (EPOCH_US(MAX(ts)) - EPOCH_US(MIN(ts))) / 1000000 AS s FROM events GROUP BY user_id)""",
)
def rates(spark: SparkSession, folder: str) -> DataFrame:
    return token_rate(table(spark, folder, "events"), ["user_id"])


@registered(
    "d15_global_ranks",
    """SELECT l_orderkey, l_partkey, l_extendedprice, RANK() OVER w AS rank, DENSE_RANK() OVER w AS dense_rank,
              PERCENT_RANK() OVER w AS percent_rank, CUME_DIST() OVER w AS cume_dist,
              SUM(l_quantity) OVER (ORDER BY l_extendedprice) AS running_total
       FROM lineitem WINDOW w AS (ORDER BY l_extendedprice)""",
)
def ranks_of_all_items(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every raw item among all items by price, and the quantity sold up to that price."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    return with_global_ranks(items, "l_extendedprice", "l_quantity").drop("l_quantity")


@registered(
    "p15_group_sample",
    """SELECT source, doc_id, n_chars FROM documents
       QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20""",
)
def sample_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty documents of every source, the same ones in every run."""
    return group_sample(table(spark, folder, "documents").select("source", "doc_id", "n_chars"), ["source"], 20, "doc_id")


@registered(
    "d13_exact_percentiles",
    """SELECT l_returnflag, fraction, COUNT(*) AS rows,
              ROUND(CASE fraction WHEN 0.01 THEN QUANTILE_CONT(l_extendedprice, 0.01)
                                  WHEN 0.25 THEN QUANTILE_CONT(l_extendedprice, 0.25)
                                  WHEN 0.5 THEN QUANTILE_CONT(l_extendedprice, 0.5)
                                  ELSE QUANTILE_CONT(l_extendedprice, 0.99) END, 4) AS percentile
       FROM lineitem, (VALUES (0.01::DOUBLE), (0.25), (0.5), (0.99)) AS f(fraction) GROUP BY l_returnflag, fraction""",
)
def price_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Prices take almost as many values as there are items."""
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_percentiles(items, ["l_returnflag"], "l_extendedprice", [0.01, 0.25, 0.5, 0.99])
    return found.withColumn("percentile", F.round("percentile", 4))


@registered(
    "d21_reachability",
    """WITH RECURSIVE ways AS (
         SELECT DISTINCT a.l_partkey AS part, b.l_partkey AS next
         FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
         WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'),
       starts AS (SELECT MIN(p_partkey) AS start FROM part GROUP BY p_brand),
       met AS (
         SELECT start, start AS node FROM starts
         UNION
         SELECT met.start, ways.next FROM met JOIN ways ON met.node = ways.part)
       SELECT start, node FROM met""",
)
def parts_returned_after(spark: SparkSession, folder: str) -> DataFrame:
    """Returned parts that follow one another in orders, in any number of steps, from the first part of every brand."""
    items = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    former = items.select("l_orderkey", F.col("l_linenumber") + 1, F.col("l_partkey").alias("part"))
    former = former.toDF("l_orderkey", "l_linenumber", "part")
    ways = former.join(items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("next")), ["l_orderkey", "l_linenumber"])
    starts = table(spark, folder, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("start")).select("start")
    return reachable(ways, "part", "next", starts).select("start", "node")


@registered(
    "d32_upsert_delete",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END
                AS o_orderstatus,
              CASE WHEN o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END
                AS o_totalprice,
              o_orderdate, o_orderpriority, CAST(YEAR(o_orderdate) AS INT) AS y
       FROM orders WHERE NOT (o_orderdate < DATE '1993-01-01' AND o_orderpriority = '5-LOW')""",
)
def changed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by year: those of the last year that are open are changed, cheap ones of the first year are deleted."""
    path = working_folder(spark, "orders")
    orders = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    upsert(orders, path, ["o_orderkey"], ["y"])
    open_ones = orders.where("o_orderdate >= DATE '1998-01-01' AND o_orderstatus = 'O'")
    raised = open_ones.withColumns({"o_orderstatus": F.lit("P"), "o_totalprice": F.col("o_totalprice") * 2})
    upsert(raised, path, ["o_orderkey"], ["y"])
    low = orders.where("o_orderdate < DATE '1993-01-01' AND o_orderpriority = '5-LOW'")
    delete_keys(spark, low.select("o_orderkey"), path, ["o_orderkey"], ["y"])
    return spark.read.parquet(path)
