"""Queries of small stores: what a record gathers, which files go, which variant is meant, who may see what; and clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import tables as tb
from evispark.plans.registry import query, sql_tokens, table
from evispark.plans.retrieval import _hint_sql


def _clauses_sql(words: list[str]) -> str:
    pattern = r"[,;:.!?]|\s(?i:" + "|".join(words) + r")\s"
    parts, signs = f"string_split_regex(text, '{pattern}')", f"list_prepend('', regexp_extract_all(text, '{pattern}'))"
    return f"list_transform(list_zip({parts}, {signs}), lambda x: {{'text': regexp_replace(x[1], '^\\s+|\\s+$', '', 'g'), 'sign': lower(trim(regexp_replace(x[2], '\\s', ' ', 'g'), ' '))}})"


@query(f"""
WITH d AS (SELECT doc_id, text, {_hint_sql('t')} AS hint FROM (SELECT doc_id, text, {sql_tokens('text')} AS t FROM documents)),
c AS (SELECT doc_id, unnest(CASE WHEN hint = 'pt' THEN {_clauses_sql(tx.CLAUSE_WORDS_PT)} ELSE {_clauses_sql(tx.CLAUSE_WORDS)} END) AS c FROM d)
SELECT doc_id, count(*) AS n, count(*) FILTER (list_contains({tx.HANGING!r}, c.sign)) AS hanging, sum(length(c.text))::BIGINT AS chars, max(c.text) AS last FROM c WHERE length(c.text) >= 8 GROUP BY doc_id""")
def f_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's clauses: how many, how many hang on another, their characters, and the last one in order of letters."""
    # an outer explode: Spark gives a plain one a filter on the array's size, which cuts up a text twice
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(tx.clauses(F.col("text"))).alias("c")).where("c IS NOT NULL")
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("c.hangs").alias("hanging"), F.sum(F.length("c.text")).alias("chars"), F.max("c.text").alias("last"))


@query("""
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type = 'purchase'),
l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events),
k AS (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2),
a AS (SELECT user_id, array_to_string(list(event_id ORDER BY r), ',') AS bought FROM p WHERE r <= 5 GROUP BY 1),
b AS (SELECT user_id, array_to_string(list(event_type || ':' || value ORDER BY r), ',') AS recent FROM l WHERE r <= 10 AND NOT (user_id % 13 = 5) GROUP BY 1),
c AS (SELECT user_id, array_to_string(list(event_type || ':' || n ORDER BY r), ',') AS kinds FROM k WHERE r <= 3 GROUP BY 1)
SELECT user_id, coalesce(bought, '') AS bought, coalesce(recent, '') AS recent, coalesce(kinds, '') AS kinds FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def r_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each user: the last five purchases, the last ten events (of some users none), the three commonest kinds."""
    events = table(spark, sf_dir, "events")
    newest = [F.desc("ts"), F.col("event_id")]
    kinds = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    parts = {
        "bought": (events.where("event_type = 'purchase'"), newest, 5),
        "recent": (events.where("user_id % 13 <> 5"), newest, 10),
        "kinds": (kinds, [F.desc("n"), F.col("event_type")], 3),
    }
    found = tb.fan_in(parts, "user_id")
    joined = lambda c, show: F.array_join(F.transform(c, show), ",").alias(c)
    kind = lambda x, n: F.concat(x["event_type"], F.lit(":"), x[n].cast("string"))
    return found.select("user_id", joined("bought", lambda x: x["event_id"].cast("string")), joined("recent", lambda x: kind(x, "value")), joined("kinds", lambda x: kind(x, "n")))


@query("""
WITH f AS (SELECT DISTINCT 'copy-' || strftime(ts, '%Y%m%d-%H') AS stem, event_id % 4 AS k FROM events),
n AS (SELECT DISTINCT stem, stem || CASE k WHEN 0 THEN '.db' WHEN 1 THEN '.extra.db' WHEN 2 THEN '.db.manifest.json' ELSE '.txt' END AS name, k FROM f),
old AS (SELECT stem FROM (SELECT stem, row_number() OVER (ORDER BY stem DESC) AS r FROM n WHERE k = 0) WHERE r > 20)
SELECT name FROM n WHERE k < 3 AND stem IN (SELECT stem FROM old)""")
def t_outdated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly copies of three files each: all but the twenty newest groups go, with their siblings; other files and lone siblings stay."""
    ends = F.when(F.col("event_id") % 4 == 0, ".db").when(F.col("event_id") % 4 == 1, ".extra.db").when(F.col("event_id") % 4 == 2, ".db.manifest.json").otherwise(".txt")
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("copy-"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd-HH"), ends).alias("name")).distinct()
    return tb.outdated_files(names, "name", r"^copy-.*\.db$", [(r"\.extra\.db$", ".db"), (r"\.db\.manifest\.json$", ".db")], 20)


@query("""
WITH v AS (SELECT n_regionkey AS family, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS kind, n_nationkey AS item FROM nation),
c AS (SELECT c_custkey, c_nationkey, 1 + c_custkey % 6 AS kind FROM customer)
SELECT c.c_custkey, coalesce(o.item, c.c_nationkey) AS variant FROM c LEFT JOIN v f ON f.item = c.c_nationkey LEFT JOIN v o ON o.family = f.family AND o.kind = c.kind""")
def j_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation of the customer's region that stands for the kind asked for, or the own one."""
    nations = table(spark, sf_dir, "nation")
    kind = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    variants = nations.select(F.col("n_regionkey").alias("family"), kind.cast("long").alias("kind"), F.col("n_nationkey").alias("item"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (1 + F.col("c_custkey") % 6).alias("kind"))
    return tb.variant_or_self(customers, variants, "c_nationkey", "kind").select("c_custkey", "variant")


@query("""
SELECT p_brand AS name, p_size AS version, first AS path, n FROM (
  SELECT p_brand, p_size, min(p_partkey) AS first, count(*) AS n FROM part WHERE p_type NOT LIKE 'PROMO%' GROUP BY 1, 2)""")
def t_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by name and version, the first place that has one, without those for development only."""
    used = table(spark, sf_dir, "part").where(~F.startswith("p_type", F.lit("PROMO")))
    return used.groupBy(F.col("p_brand").alias("name"), F.col("p_size").alias("version")).agg(F.min("p_partkey").alias("path"), F.count("*").alias("n"))


@query("""
WITH live AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0),
denied AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60)
SELECT c_name, count(DISTINCT event_type) AS seen, coalesce(array_to_string(list_sort(list(DISTINCT event_type)), ','), '') AS kinds
FROM live LEFT JOIN (SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM denied d WHERE d.user_id = e.user_id AND d.event_type = e.event_type)) e ON e.user_id = c_custkey GROUP BY c_name""")
def r_live_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live contacts by name with the set of what they may do: a deny list holds (contact, capability) pairs."""
    live = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    denied = events.where("value > 60").select("user_id", "event_type").distinct()
    allowed = events.select("user_id", "event_type").distinct().join(denied, ["user_id", "event_type"], "left_anti")
    kinds = F.array_sort(F.collect_set("event_type"))
    grouped = live.join(allowed, "user_id", "left").groupBy("c_name").agg(kinds.alias("k"))
    return grouped.select("c_name", F.size("k").cast("long").alias("seen"), F.array_join("k", ",").alias("kinds"))
