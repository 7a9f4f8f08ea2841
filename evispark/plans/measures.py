"""Queries that measure: routers, leaks, profiles, floors, languages, signals; and texts of sinks and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import aggregates as ag
from evispark.operators import ranking as rk
from evispark.operators import similarity as sm
from evispark.plans import retrieval as rt
from evispark.plans.registry import query, table
from evispark.sources import text_tables as st


@query("""
SELECT user_id, count(*) FILTER (event_type <> 'error') AS n, count(*) FILTER (event_type = 'error') AS dropped, quantile_disc(value, 0.5) FILTER (event_type <> 'error') AS p50, quantile_disc(value, 0.95) FILTER (event_type <> 'error') AS p95,
  max(value) FILTER (event_type <> 'error') AS most, round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS mean_or_zero, CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN '-' ELSE floor(100.0 * count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type <> 'error') + 0.5)::INT::VARCHAR END AS view_percent
FROM events WHERE value >= 0 AND isfinite(value) GROUP BY user_id""")
def a_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies and outcomes of each user's samples; errors count as dropped only."""
    rows = table(spark, sf_dir, "events").where(ag.finite(F.col("value")) & (F.col("value") >= 0))
    kept, kind = rows.where("event_type <> 'error'"), lambda k: F.col("event_type") == k
    ranks = ag.percentiles(kept, "user_id", "value", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95)}).select("user_id", "p50", "p95")
    n = F.count_if(~kind("error"))
    percent = F.when(n == 0, "-").otherwise(F.floor(100.0 * F.count_if(kind("view")) / F.greatest(n, F.lit(1)) + 0.5).cast("int").cast("string"))
    counts = rows.groupBy("user_id").agg(
        n.alias("n"), F.count_if(kind("error")).alias("dropped"), F.max(F.when(~kind("error"), F.col("value"))).alias("most"),
        F.round(F.coalesce(F.avg(F.when(kind("purchase"), F.col("value"))), F.lit(0.0)), 6).alias("mean_or_zero"), percent.alias("view_percent"),
    )
    return counts.join(ranks, "user_id", "left").select("user_id", "n", "dropped", "p50", "p95", "most", "mean_or_zero", "view_percent")


@query("""
WITH t AS (SELECT unnest(string_split(event_type || CASE event_id % 4 WHEN 0 THEN ',Bad Label' WHEN 1 THEN ',view' ELSE '' END, ',')) AS tool FROM events WHERE event_type <> 'error')
SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT CASE WHEN regexp_matches(tool, '^[a-z][a-z0-9_]{0,39}$') THEN tool ELSE 'other' END AS label, count(*) AS n FROM t GROUP BY 1)""")
def a_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of comma-separated lists, by safe label; most frequent first, then by name."""
    more = F.when(F.col("event_id") % 4 == 0, ",Bad Label").when(F.col("event_id") % 4 == 1, ",view").otherwise("")
    tools = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.explode(F.split(F.concat("event_type", more), ",")).alias("tool"))
    counted = tools.groupBy(tx.label(F.col("tool")).alias("label")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # one row for each label


_KINDS = ("signup", "purchase", "view", "click", "error")


@query(f"SELECT user_id, concat_ws(', ', {', '.join(f'''CASE WHEN count(*) FILTER (event_type = '{k}') > 0 THEN count(*) FILTER (event_type = '{k}') || ' {k}' || CASE WHEN count(*) FILTER (event_type = '{k}') > 1 THEN 's' ELSE '' END END''' for k in _KINDS)}) AS said FROM events GROUP BY user_id")
def a_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's events are, in a fixed order, zeroes left out, in the singular or plural."""
    def part(kind: str):
        n = F.count_if(F.col("event_type") == kind)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {kind}"), F.when(n > 1, "s").otherwise("")))

    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws(", ", *map(part, _KINDS)).alias("said"))


@query("SELECT o_custkey AS region, count(*) AS facts, count(*) < 12 AS violation FROM orders GROUP BY o_custkey")
def a_floor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (orders) of each region (customer), and whether there are fewer than the floor of twelve."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("region")).agg(F.count("*").alias("facts"), (F.count("*") < 12).alias("violation"))


@query("SELECT o_orderpriority AS runner, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O') AS passed FROM orders GROUP BY ROLLUP (o_orderpriority)")
def a_test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by status for each runner and over all."""
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderpriority").alias("runner")).agg(F.count("*").alias("n"), status("F").alias("failed"), status("O").alias("passed"))


@query("SELECT user_id, CASE WHEN bool_or(value - 1 < 0) THEN 'invalid' WHEN sum(value - 1) > 2000 THEN 'exceeded' ELSE 'ok' END AS status, CASE WHEN NOT bool_or(value - 1 < 0) AND sum(value - 1) <= 2000 THEN round(sum(value - 1), 4) END AS total FROM events GROUP BY user_id")
def a_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units summed over a user's nodes: invalid if one is negative or not finite, exceeded over 2,000."""
    units = F.col("value") - 1
    bad = F.bool_or(~ag.finite(units) | (units < 0))
    status = F.when(bad, "invalid").when(F.sum(units) > 2000, "exceeded").otherwise("ok")
    summed = table(spark, sf_dir, "events").groupBy("user_id").agg(status.alias("status"), F.round(F.sum(units), 4).alias("total"))
    return summed.select("user_id", "status", F.when(F.col("status") == "ok", F.col("total")).alias("total"))


@query("""
SELECT "column", count(DISTINCT cell) FILTER (cell <> '') AS kinds, count(*) FILTER (cell = '') AS empties FROM (
  SELECT 'source' AS "column", trim(coalesce(source, ''), ' ') AS cell FROM documents UNION ALL SELECT 'lang', trim(coalesce(lang, ''), ' ') FROM documents) GROUP BY 1""")
def t_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and empty cells of text columns."""
    cells = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(c, F.lit(""))).alias("cell")) for c in ("source", "lang")])).alias("x")).select("x.*")
    each = cells.groupBy("column", "cell").agg(F.count("*").alias("n"))
    return each.groupBy("column").agg(F.count_if(F.col("cell") != "").alias("kinds"), F.coalesce(F.sum(F.when(F.col("cell") == "", F.col("n"))), F.lit(0)).alias("empties"))


@query("""
SELECT p_partkey, place FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY try_cast(replace(cell, ',', '.') AS DOUBLE) DESC NULLS LAST, cell DESC, p_partkey) AS place
  FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE replace(p_size::VARCHAR || ',5', ',', CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE '.' END) END AS cell FROM part)) WHERE place <= 5""")
def k_table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest cells of each brand: as numbers (decimal comma or point) where they are, else as text."""
    from evispark.operators.tables import as_number

    number = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ",5").otherwise(".5"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(number).alias("cell"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(as_number(F.col("cell")).desc_nulls_last(), F.desc("cell"), "p_partkey"))
    return rows.select("p_partkey", place.alias("place")).where("place <= 5")


_PAIRS = """
WITH pairs AS (SELECT a.vec_id AS q, a.label AS lang, a.vec_id % 100 = 0 AS answerable, b.vec_id AS doc, b.label = a.label AS hit, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) <= 4)"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(q, lang, answerable) of the questions, and their best four with whether they are of the question's label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding", "label")
    asked = vectors.where("doc % 50 = 0")
    queries = asked.select(F.col("doc").alias("q"), F.col("label").alias("lang"), (F.col("doc") % 100 == 0).alias("answerable"))
    best = sm.similar(vectors.select("doc", "embedding"), asked.select(F.col("doc").alias("q"), F.col("embedding").alias("asked")), k=4)
    return queries, best.join(queries, "q").join(vectors.select("doc", "label"), "doc").withColumn("hit", F.col("label") == F.col("lang"))


@query(f"""{_PAIRS}, s AS (SELECT q, any_value(lang) AS lang, any_value(answerable) AS answerable, bool_or(hit AND score >= 0.2) AS found, bool_or(score >= 0.2) AS got FROM top GROUP BY q),
l AS (SELECT lang::VARCHAR AS lang, avg(CASE WHEN answerable THEN found::INT END) AS recall, avg(CASE WHEN NOT answerable THEN got::INT END) AS false_rate FROM s GROUP BY lang)
SELECT lang, round(recall, 6) AS recall, round(false_rate, 6) AS false_rate FROM l UNION ALL SELECT 'mean', round(avg(recall), 6), round(avg(false_rate), 6) FROM l""")
def h_language_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of answerable questions and false accepts of the others at a floor of 0.2, by label, and their means over the labels."""
    queries, best = _judged(spark, sf_dir)
    rates = rk.recall_by_language(queries, best.where("score >= 0.2"))
    shown = [F.round(c, 6).alias(c) for c in ("recall", "false_rate")]
    mean = rates.agg(F.avg("recall").alias("recall"), F.avg("false_rate").alias("false_rate")).select(F.lit("mean").alias("lang"), *shown)
    return rates.select(F.col("lang").cast("string").alias("lang"), *shown).unionByName(mean)


@query(f"""{_PAIRS}, grid AS (SELECT unnest(range(0, 81)) AS i), s AS (SELECT i, q, any_value(lang) AS lang, any_value(answerable) AS answerable, bool_or(hit AND score >= i * 0.005::DOUBLE) AS found, bool_or(score >= i * 0.005::DOUBLE) AS got FROM top, grid GROUP BY i, q),
l AS (SELECT i, lang, avg(CASE WHEN answerable THEN found::INT END) AS recall, avg(CASE WHEN NOT answerable THEN got::INT END) AS fa FROM s GROUP BY i, lang),
m AS (SELECT i, avg(recall) AS recall, coalesce(avg(fa), 0) AS fa FROM l GROUP BY i)
SELECT round(i * 0.005, 3)::DOUBLE AS floor, round(recall, 6) AS recall, round(fa, 6) AS false_rate FROM m WHERE fa <= 0.8 + 1e-9 QUALIFY row_number() OVER (ORDER BY round(recall, 9) DESC, i DESC) = 1""")
def h_floor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the floors 0 to 0.4 in steps of 0.005 with a mean of false accepts of at most 0.8, the one of greatest mean recall; among equals the highest."""
    queries, best = _judged(spark, sf_dir)
    return rk.choose_floor(queries, best, [round(i * 0.005, 3) for i in range(81)], 0.8)


@query(f"""{rt._BM25}, r AS ({rt._top('gated', 6, 'q, doc, rank')}), parts AS (
  SELECT doc_id AS doc, 2 AS weight, unnest({rt.sql_tokens("split_part(text, chr(10), 1)")}) AS token FROM documents UNION ALL SELECT doc_id, 1, unnest({rt.sql_tokens("text")}) FROM documents),
tf AS (SELECT q, doc, sum(weight)::BIGINT AS score FROM parts JOIN qk ON key = '=' || token GROUP BY q, doc), x AS ({rt._top('tf', 2, 'q, doc')}),
e AS (SELECT x.q, min(r.rank) AS best, count(r.rank) = count(*) AS all_found FROM x LEFT JOIN r ON r.q = x.q AND r.doc = x.doc GROUP BY x.q)
SELECT count(*) AS n, round(avg((coalesce(best, 99) <= 1)::INT), 6) AS hit1, round(avg((coalesce(best, 99) <= 3)::INT), 6) AS hit3, round(avg((coalesce(best, 99) <= 6)::INT), 6) AS hit6, round(avg(all_found::INT), 6) AS all_found, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM e""")
def h_evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical search's best six judged by the two documents of greatest field count."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    ranked = rk.top_k(rt._gated(*rt._scored(spark, sf_dir)), 6)
    expected = rk.top_k(rk.field_weighted_tf(docs, rt._terms(spark, sf_dir), "doc_id", "title", "text"), 2).select("q", "doc")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return rk.evaluate(ranked, expected).agg(F.count("*").alias("n"), rate("hit1"), rate("hit3"), rate("hit6"), rate("all_found"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("SELECT event_id, round(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END, 6) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))")
def w_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value's distance from the user's mean in standard deviations."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    ends = events.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return events.join(ends, "user_id").select("event_id", F.round(F.when(F.col("sd") > 0, (F.col("value") - F.col("m")) / F.col("sd")).otherwise(0.0), 6).alias("z"))


_GRID = 6 * 3600 * 1_000_000


@query(f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS t0, value AS x0, lead(epoch_us(ts)) OVER w AS t1, lead(value) OVER w AS x1, first_value(epoch_us(ts)) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, t0, t1, x0, x1, s, unnest(range(ceil((t0 - s) / {_GRID})::BIGINT, ceil((t1 - s) / {_GRID})::BIGINT)) AS i FROM e WHERE t1 > t0)
SELECT user_id, i, round(x0 + (x1 - x0) * ((s + i * {_GRID} - t0) / (t1 - t0)), 6) AS x FROM g""")
def w_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values on a grid of six hours from the first event on, by linear interpolation."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("t", t)
    pairs = rows.select("user_id", F.col("t").alias("t0"), F.col("value").alias("x0"), F.lead("t").over(order).alias("t1"), F.lead("value").over(order).alias("x1"), F.min("t").over(Window.partitionBy("user_id")).alias("s")).where("t1 > t0")
    step = lambda c: F.ceil((F.col(c) - F.col("s")) / _GRID).cast("long")
    grid = pairs.where(step("t1") > step("t0")).withColumn("i", F.explode(F.sequence(step("t0"), step("t1") - 1)))
    share = (F.col("s") + F.col("i") * _GRID - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return grid.select("user_id", "i", F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * share, 6).alias("x"))


@query("""
WITH e AS (SELECT user_id, event_id, value AS b, row_number() OVER w AS i, lag(value) OVER w AS a, lead(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, max(b) OVER (PARTITION BY user_id) AS top FROM e WHERE b >= a AND b >= c AND b > 0)
SELECT user_id, i, round(i + CASE WHEN a - 2 * b + c < 0 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END, 6) AS refined FROM p WHERE b >= 0.85 * top QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) = 1""")
def w_first_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first local maximum of at least 0.85 of the highest one, refined by a parabola."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("i"), F.lag("value").over(order).alias("a"), F.col("value").alias("b"), F.lead("value").over(order).alias("c"))
    peaks = near.where("b >= a AND b >= c AND b > 0")
    top = peaks.groupBy("user_id").agg(F.max("b").alias("top"))
    first = peaks.join(top, "user_id").where(F.col("b") >= 0.85 * F.col("top")).groupBy("user_id").agg(F.min(F.struct("i", "a", "b", "c")).alias("p")).select("user_id", "p.*")
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    return first.select("user_id", "i", F.round(F.col("i") + F.when(bend < 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0), 6).alias("refined"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(text, '\\r?\\n'), lambda l: trim(l, ' ') <> ''), lambda l: replace(l, ',', ' | ')), chr(10)) AS text FROM documents")
def x_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as CSV files: blank lines out, bars for commas."""
    return table(spark, sf_dir, "documents").select("doc_id", st.csv_to_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, doc_id || ',' || CASE WHEN regexp_matches(t, '[",\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END || ',' || coalesce(source, '') || ',a|b' AS line FROM (SELECT doc_id, source, coalesce(CASE WHEN doc_id % 5 <> 0 THEN '"' || text END, '') AS t FROM documents)""")
def x_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV lines: nulls, quotes, commas, line ends and arrays."""
    text = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit('"'), "text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "source", F.array(F.lit("a"), F.lit("b")).alias("marks"))
    return rows.select("doc_id", st.csv_line(rows).alias("line"))


@query("SELECT event_id AS run, event_type AS query FROM events WHERE event_id % 4 IN (0, 1)")
def x_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results out of a log: marked lines, bare objects; broken ones and those without a query are dropped."""
    body = F.to_json(F.struct(F.col("event_id").alias("run"), F.col("event_type").alias("query")))
    k = F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("12:00 info [EVAL] "), body)).when(k == 1, F.concat(F.lit("  "), body)).when(k == 2, F.substring(body, 1, 9)).otherwise(F.concat(F.lit('{"run": '), "event_id", F.lit("}")))
    schema = spark.createDataFrame([], "run long, query string").schema
    return st.log_rows(table(spark, sf_dir, "events").select(line.alias("value")), schema, ["run", "query"])
