"""Queries over tables: filters, profiles, joins, windows, maintenance and telemetry aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import aggregates as ag
from evispark.operators import tables as tb
from evispark.plans.registry import query, sql_token_estimate, table


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal >= 1000.5 AND lower(c_name) <> 'customer#000000007'")
def t_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.where(tb.parse_filter(customer, "C_MktSegment=Building; c_acctbal>=1000,5 ;c_name!=CUSTOMER#000000007")).select("c_custkey", "c_name")


@query("""
SELECT "column", count(*) AS n, round(sum(x), 2) AS total, round(avg(x), 4) AS mean, min(x) AS low, max(x) AS high FROM (
  SELECT 'p_partkey' AS "column", p_partkey::DOUBLE AS x FROM part UNION ALL SELECT 'p_size', p_size::DOUBLE FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY 1""")
def t_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tb.numeric_profile(table(spark, sf_dir, "part"))
    return found.select("column", "n", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "low", "high")


@query("SELECT value, n, rank FROM (SELECT p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS rank FROM part GROUP BY p_type) WHERE rank <= 5")
def t_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.top_values(table(spark, sf_dir, "part"), "p_type", F.col("p_partkey"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def t_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH b AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1),
c AS (SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase' AND value > 100) WHERE r = 1)
SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM c) UNION ALL SELECT * FROM c""")
def t_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, replaced by the last large purchase where there is one."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts", "event_type")
    first = tb.newest(events, 1, [F.col("ts"), F.col("event_id")], ["user_id"]).select("user_id", "event_id", "value")
    last = tb.keep_last(events.where("event_type = 'purchase' AND value > 100"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")
    return tb.upsert(first, last, ["user_id"])


@query("""
SELECT coalesce(c.c_custkey, o.k) AS key, coalesce(o.s, c.c_mktsegment) AS segment, coalesce(o.b, c.c_acctbal) AS balance FROM customer c
FULL JOIN (SELECT o_custkey + 1 AS k, CASE WHEN count(*) > 10 THEN 'BUSY' END AS s, round(max(o_totalprice), 2) AS b FROM orders GROUP BY o_custkey) o ON o.k = c.c_custkey""")
def t_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their neighbour's figures patched in; a null in the patch keeps the old value."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    changes = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 1).alias("key")).agg(F.when(F.count("*") > 10, "BUSY").alias("segment"), F.round(F.max("o_totalprice"), 2).alias("balance"))
    return tb.patch(base, changes, ["key"])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def t_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.newest(table(spark, sf_dir, "events"), 5, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id) AS total,
  coalesce(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE total - before > 100000""")
def t_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest events to drop until each user holds at most 1000 units."""
    events = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return tb.evict(events, ["user_id"], [F.col("ts"), F.col("event_id")], "cents", 100_000).select("user_id", "event_id")


@query(f"""
WITH c AS (SELECT conv_id, turn, {sql_token_estimate("text")} AS cost FROM conversations)
SELECT conv_id, turn FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM c) WHERE s <= 400""")
def t_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that fit 400 estimated tokens."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("cost"))
    return tb.within_budget(turns, ["conv_id"], [F.desc("turn")], "cost", 400).select("conv_id", "turn")


@query("""
SELECT a.conv_id, a.turn, (SELECT u.turn FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn ORDER BY u.turn DESC LIMIT 1) AS asked
FROM conversations a WHERE a.role = 'assistant'""")
def t_previous_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(before))
    return turns.where("role = 'assistant'").select("conv_id", "turn", "asked")


_NEXT = """
SELECT v.user_id, v.event_id, p.ts AS next_time, p.value AS next_value
FROM events v LEFT JOIN events p ON p.event_id = (
  SELECT arg_min(n.event_id, (n.ts, n.event_id)) FROM events n
  WHERE n.user_id = v.user_id AND n.event_type = 'purchase' AND n.ts {op} v.ts {within})
WHERE v.event_type = 'view'"""


@query(_NEXT.format(op=">=", within="AND n.ts <= v.ts + INTERVAL 1 DAY"))
def j_next_purchase_in_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next(spark, sf_dir, within="INTERVAL 1 DAY")


@query(_NEXT.format(op=">", within=""))
def j_next_purchase_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next(spark, sf_dir, strict=True)


def _next(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "event_id", "ts")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value", F.col("event_id").alias("buy_id"))
    found = tb.next_event(views, buys, ["user_id"], "ts", "at", "value", ties=["buy_id"], **how)
    return found.select("user_id", "event_id", "next_time", "next_value")


@query("""
WITH risks AS (SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase')),
firsts AS (SELECT v.event_id, arg_min(r.event_type, (r.ts, r.event_id)) AS kind, arg_min(r.value, (r.ts, r.event_id)) AS value
  FROM events v LEFT JOIN risks r ON r.user_id = v.user_id AND r.ts >= v.ts AND r.ts <= v.ts + INTERVAL 1 HOUR
  WHERE v.event_type = 'click' GROUP BY v.event_id)
SELECT CASE WHEN kind = 'error' AND value > 20 THEN 'memory' WHEN kind = 'error' THEN 'crash' ELSE 'unknown' END AS cause, count(*) AS n FROM firsts GROUP BY 1""")
def j_interruption_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first exit within the hour after each start says of its end: an exit is an error or a purchase, the value tells the kind."""
    events = table(spark, sf_dir, "events")
    starts = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    exits = events.where("event_type IN ('error', 'purchase')").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("exit_id"), F.struct("event_type", "value").alias("exit"))
    found = tb.next_event(starts, exits, ["user_id"], "ts", "at", "exit", ties=["exit_id"], within="INTERVAL 1 HOUR")
    error = F.col("next_value.event_type") == "error"
    cause = F.when(error & (F.col("next_value.value") > 20), "memory").when(error, "crash").otherwise("unknown")
    return found.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT event_id, n_nationkey FROM events, nation WHERE value BETWEEN n_nationkey * 10 AND n_nationkey * 10 + 14")
def j_value_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10.0).alias("low"), (F.col("n_nationkey") * 10.0 + 14).alias("high"))
    return tb.range_join(table(spark, sf_dir, "events").select("event_id", "value"), ranges, "value", "low", "high", 10.0).select("event_id", "n_nationkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j_has_large_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def j_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("revenue"))  # before the joins: one row for each customer
    joined = by_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'changed' END AS status,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'price' END AS fields FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0
UNION ALL SELECT -1, 'extra', NULL""")
def t_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers of the orders: one lacks every eleventh, prices differ in every seventh, one row is new."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))
    b = a.where("key % 11 <> 0").withColumn("price", F.when(F.col("key") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0.0).alias("price"), F.lit("O").alias("state"))
    return tb.diff(a, b.unionByName(extra), ["key"])


@query("""
SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.1), 6) AS p10, round(median(value), 6) AS median,
  list_sort(list(value))[least(count(*), (floor(count(*) * 0.95) + 1)::BIGINT)] AS floor_p95 FROM events WHERE isfinite(value) GROUP BY event_type""")
def a_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank, interpolated, median and floor-rank percentiles of the finite values."""
    points = {"p95": ("nearest", 0.95), "p90": ("between", 0.9), "p10": ("between", 0.1), "median": ("between", 0.5), "floor_p95": ("floor", 0.95)}
    found = ag.percentiles(table(spark, sf_dir, "events"), "event_type", "value", points)
    return found.select("event_type", "n", "p95", "floor_p95", *(F.round(c, 6).alias(c) for c in ("p90", "p10", "median")))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 50) AS large, round(avg(value) FILTER (event_type = 'view'), 6) AS mean_view,
  round(100.0 * count(*) FILTER (event_type = 'error') / count(*))::BIGINT AS error_percent, count(DISTINCT event_type) AS kinds, max(ts) AS last_seen FROM events GROUP BY user_id""")
def a_user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    errors = F.count_if(kind("error"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), errors.alias("errors"), F.count_if(kind("purchase") & (F.col("value") > 50)).alias("large"), F.round(F.avg(F.when(kind("view"), F.col("value"))), 6).alias("mean_view"),
        F.floor(100 * errors / F.count("*") + 0.5).alias("error_percent"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("last_seen"),
    )


@query("SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source UNION ALL SELECT NULL, count(*), sum(strlen(text))::BIGINT FROM documents")
def a_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bytes by source, and in all."""
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


@query("""
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events""")
def w_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(order.rowsBetween(-3, 3)), 6).alias("smooth"), F.round(F.sum("value").over(past), 4).alias("running"), F.max("value").over(past).alias("peak"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events),
p AS (SELECT user_id, x, lead(x, 3) OVER (PARTITION BY user_id ORDER BY i) AS y FROM e)
SELECT user_id, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 0), 5) AS r FROM p WHERE y IS NOT NULL GROUP BY user_id""")
def w_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each user's values with those three events later, over both segments' energy."""
    user = Window.partitionBy("user_id")
    centred = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") - F.avg("value").over(user)).alias("x"))
    pairs = centred.withColumn("y", F.lead("x", 3).over(user.orderBy("ts", "event_id"))).where("y IS NOT NULL")
    energy = F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return pairs.groupBy("user_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("x") * F.col("y")), energy), F.lit(0.0)), 5).alias("r"))
