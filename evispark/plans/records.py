"""Queries of record keeping: joins with rules, resolution, merging, visibility, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import entities as en
from evispark.operators import ranking as rk
from evispark.plans.registry import query, table
from evispark.plans.texts import SQL_CHUNKS


@query("""
WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'week' END AS every FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS every FROM orders WHERE o_orderkey % 5 = 0)
SELECT id, every, n FROM (SELECT o_orderkey AS id, coalesce(a.every, b.every) AS every, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS n
  FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey WHERE o_orderstatus <> 'F' AND (o_orderkey % 11 = 0 OR o_orderdate <= TIMESTAMP '1998-01-01')) WHERE n <= 10""")
def r_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reminders (orders) that are due, with a cadence from either of two tables, by due date, those without one last."""
    orders = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    first = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(even, "day").otherwise("week").alias("one"))
    second = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(even, "month").otherwise("year").alias("two"))
    due = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", due.alias("due")).where("o_orderstatus <> 'F' AND (due IS NULL OR due <= TIMESTAMP_NTZ '1998-01-01 00:00:00')")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("due").asc_nulls_last(), "o_orderkey"))
    joined = rows.join(first, "o_orderkey", "left").join(second, "o_orderkey", "left")
    return joined.select(F.col("o_orderkey").alias("id"), F.coalesce("one", "two").alias("every"), n.alias("n")).where("n <= 10")


@query("SELECT c.conv_id, c.turn, l.quality AS rating, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS n FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 3 + c.turn")
def r_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in order with their rating, if there is one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"))
    rated = turns.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("rating")), "doc_id", "left")
    return rated.select("conv_id", "turn", "rating", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(c_name) NOT IN (SELECT lower(upper(c_name)) FROM customer WHERE c_acctbal > 3000)")
def r_unknown_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (orders) whose sender's name is no contact's, whatever its case."""
    customer = table(spark, sf_dir, "customer")
    sent = table(spark, sf_dir, "orders").join(customer.select("c_custkey", F.lower("c_name").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    contacts = customer.where("c_acctbal > 3000").select(F.lower(F.upper("c_name")).alias("k"))
    return sent.join(contacts, "k", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, s.c_custkey AS contact FROM orders JOIN customer c ON c.c_custkey = o_custkey JOIN customer s ON lower(s.c_name) = lower(c.c_name) WHERE s.c_acctbal < 0")
def r_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to superseded contacts (of negative balance), by lower-cased name."""
    customer = table(spark, sf_dir, "customer")
    sent = table(spark, sf_dir, "orders").join(customer.select("c_custkey", F.lower("c_name").alias("k")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "k")
    return sent.join(customer.where("c_acctbal < 0").select(F.lower("c_name").alias("k"), F.col("c_custkey").alias("contact")), "k").select("o_orderkey", "contact")


@query("SELECT user_id, event_id, rejected FROM (SELECT e.user_id, e.event_id, r.event_id AS rejected, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC, r.event_id DESC) AS n FROM events e JOIN events r ON r.user_id = e.user_id AND r.event_type = 'error' AND r.ts::DATE = e.ts::DATE WHERE e.event_type = 'purchase') WHERE n <= 5")
def r_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest purchases with the errors of the same day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    bad = events.where("event_type = 'error'").select("user_id", "day", F.col("event_id").alias("rejected"))
    joined = events.where("event_type = 'purchase'").join(bad, ["user_id", "day"])
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"), F.desc("rejected")))
    return joined.withColumn("n", n).where("n <= 5").select("user_id", "event_id", "rejected")


_WORDS = "' ' || trim(regexp_replace({}, '[^{}0-9]+', ' ', 'g'), ' ') || ' '"


@query(f"""
WITH a AS (SELECT item_id AS entity, CASE WHEN item_id % 2 = 0 THEN lower(x) ELSE x END AS alias FROM (SELECT item_id, array_to_string(list_slice(string_split_regex(text, '[^A-Za-z]+'), 1, 1 + (item_id % 2)::INT), ' ') AS x FROM benchmark)),
n AS (SELECT entity, alias, alias <> lower(alias) AS cased, {_WORDS.format("CASE WHEN alias <> lower(alias) THEN alias ELSE lower(strip_accents(alias)) END", "A-Za-z")} AS needle FROM a),
d AS (SELECT doc_id, {_WORDS.format("lower(strip_accents(text))", "a-z")} AS low, {_WORDS.format("text", "A-Za-z")} AS high FROM documents)
SELECT doc_id AS id, entity, alias FROM (SELECT doc_id, entity, alias, row_number() OVER (PARTITION BY doc_id ORDER BY length(needle) DESC, entity) AS r FROM d JOIN n ON length(trim(needle, ' ')) >= 2 AND CASE WHEN cased THEN contains(high, needle) ELSE contains(low, needle) END) WHERE r = 1""")
def r_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name (an item's first word or two) in each document."""
    words = F.split("text", "[^A-Za-z]+")
    name = F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 2 + 1).cast("int")), " ")
    aliases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.when(F.col("item_id") % 2 == 0, F.lower(name)).otherwise(name).alias("alias"))
    return en.longest_alias(table(spark, sf_dir, "documents"), aliases, "doc_id", "text")


@query("""
WITH f AS (SELECT o_orderkey % 3 AS pack, o_custkey AS region, CASE WHEN o_orderpriority LIKE '1%' THEN 'emergency.' ELSE 'misc.' END || o_orderstatus AS key, min(o_orderkey) AS id FROM orders GROUP BY 1, 2, 3),
w AS (SELECT region, min(pack) AS owner FROM f GROUP BY region), k AS (SELECT f.* FROM f JOIN w USING (region) WHERE pack = owner OR key NOT LIKE 'emergency.%')
SELECT region, key, pack, id FROM (SELECT *, row_number() OVER (PARTITION BY region, key ORDER BY pack) AS r FROM k) WHERE r = 1""")
def r_merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three packs: a region's emergency keys come from its first pack alone."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "emergency.").otherwise("misc.")
    orders = table(spark, sf_dir, "orders")
    facts = orders.groupBy((F.col("o_orderkey") % 3).alias("pack"), F.col("o_custkey").alias("region"), F.concat(kind, "o_orderstatus").alias("key")).agg(F.min("o_orderkey").alias("id"))
    return en.merge_packs(facts).select("region", "key", "pack", "id")


@query("""
SELECT region, key, n, first_check, row_number() OVER (PARTITION BY region ORDER BY coalesce(list_position(['emergency.F', 'emergency.O'], key), 99), key) AS place FROM (
  SELECT o_custkey % 20 AS region, 'emergency.' || o_orderstatus AS key, count(*) AS n, min(o_orderdate) AS first_check FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2)""")
def r_fact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emergency facts by region: how many, the earliest check, in a fixed order of keys, unknown ones last."""
    urgent = table(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1")))
    facts = urgent.groupBy((F.col("o_custkey") % 20).alias("region"), F.concat(F.lit("emergency."), "o_orderstatus").alias("key")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_check"))
    order = F.when(F.col("key") == "emergency.F", 1).when(F.col("key") == "emergency.O", 2).otherwise(99)
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(order, "key")))


@query("SELECT c.c_custkey AS id, n.c_custkey AS successor FROM customer c LEFT JOIN customer n ON c.c_custkey % 3 = 0 AND n.c_custkey = c.c_custkey * 7 % 1000 AND n.c_acctbal > 0")
def r_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live customer that every third one was superseded by, if any; one hop."""
    rows = table(spark, sf_dir, "customer").withColumn("next", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 7 % 1000))
    return en.successors(rows, "c_custkey", "next", F.col("c_acctbal") > 0)


@query("""
WITH k AS (SELECT lower(p_name) AS k, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT p_partkey AS q, lower(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '  x' ELSE p_name || ' ' END) AS name FROM part)
SELECT q, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS kind, CASE WHEN n = 1 THEN id END AS id FROM q LEFT JOIN k ON k = trim(regexp_replace(name, '\\s+', ' ', 'g'), ' ')""")
def r_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in other cases, with spaces, or with a word too many: found once, often or not at all."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("  x"))).otherwise(F.concat("p_name", F.lit(" ")))
    return en.resolve_names(part.select(F.col("p_partkey").alias("q"), name.alias("name")), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""
WITH a AS (SELECT o_custkey AS q, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders QUALIFY i <= 3),
b AS (SELECT o_custkey AS q, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS i FROM orders QUALIFY i <= 3),
u AS (SELECT q, doc, 0 AS side, i FROM a UNION ALL SELECT q, doc, 1, i FROM b WHERE (q, doc) NOT IN (SELECT q, doc FROM a))
SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY side, i) AS place FROM u""")
def r_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of a customer, then the three newest that aren't among them."""
    orders = table(spark, sf_dir, "orders")
    top = lambda order: orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(order.desc(), "o_orderkey")).alias("i")).where("i <= 3")
    first, more = top(F.col("o_totalprice")), top(F.col("o_orderdate"))
    both = first.withColumn("side", F.lit(0)).unionByName(more.join(first, ["q", "doc"], "left_anti").withColumn("side", F.lit(1)))
    return both.select("q", "doc", F.row_number().over(Window.partitionBy("q").orderBy("side", "i")).alias("place"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE coalesce(source, '') <> 'src3' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def r_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three tables keep when a source is deleted with all that hangs on its documents."""
    gone = table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id")
    kept = []
    for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("doc_id")).join(gone, "doc_id", "left_anti")
        kept.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("SELECT c_custkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 4 <> 0 WHERE n_nationkey IS NULL OR n_regionkey IN (1, 3)")
def r_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of no collection, or of an active one."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("n_nationkey"))
    joined = customer.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "left")
    return joined.where("n_nationkey IS NULL OR n_regionkey IN (1, 3)").select("c_custkey")


@query("SELECT event_id FROM events e WHERE (event_id % 5 = 0 OR ts + INTERVAL 1 HOUR * (event_id % 100) > TIMESTAMP '2024-01-10') AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.value > 200 AND d.user_id = e.user_id)")
def r_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an expiry or before it, but for those of denied users."""
    events = table(spark, sf_dir, "events")
    expiry = F.when(F.col("event_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 100) * 3_600_000_000)
    now = F.unix_micros(F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    denied = events.where("event_type = 'error' AND value > 200").select("user_id")
    return events.where(expiry.isNull() | (expiry > now)).join(denied, "user_id", "left_anti").select("event_id")


_ASKED = "(VALUES (1, 'CUSTOMER#00000001'), (2, '00012'), (3, ''), (4, 'ñone'), (5, '99')) AS a(q, text)"


@query(f"""
SELECT q, c_custkey, n FROM (SELECT q, c_custkey, row_number() OVER (PARTITION BY q ORDER BY c_custkey) AS n FROM {_ASKED} JOIN customer ON text <> ''
  AND (contains(lower(c_name), lower(text)) OR (length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(c_name, '[^0-9]', '', 'g'), regexp_replace(text, '[^0-9]', '', 'g'))))) WHERE n <= 5""")
def r_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts whose name holds the question, or whose number holds its four or more digits; five at most; nothing for an empty one."""
    asked = [(1, "CUSTOMER#00000001"), (2, "00012"), (3, ""), (4, "ñone"), (5, "99")]
    customer = table(spark, sf_dir, "customer").select("c_custkey", tx.fold(F.col("c_name")).alias("name"), F.regexp_replace("c_name", "[^0-9]", "").alias("number"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    hits = [F.when(F.lit(text != "") & (F.contains("name", tx.fold(F.lit(text))) | ((F.length(digits(F.lit(text))) >= 4) & F.contains("number", digits(F.lit(text))))), F.lit(q)) for q, text in asked]
    found = customer.select("c_custkey", F.explode(F.array_compact(F.array(*hits))).alias("q"))  # one scan for all questions
    return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("c_custkey"))).where("n <= 5").select("q", "c_custkey", "n")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'wid')")
def r_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold every word of the question."""
    words = F.split(F.trim(tx.fold(F.lit(" Réd WID "))), r"\s+")
    return table(spark, sf_dir, "part").where(F.forall(words, lambda w: F.contains(tx.fold(F.col("p_name")), w))).select("p_partkey")


@query(r"SELECT c_custkey FROM customer WHERE c_name || '_%' = 'Customer#000000007_%' OR c_name || '_%' LIKE '%#00000001\__%' ESCAPE '\' OR c_name || '_%' LIKE '%00012\_\%' ESCAPE '\'")
def r_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by equality or by a pattern with escaped signs."""
    title = F.concat("c_name", F.lit("_%"))
    hit = (title == "Customer#000000007_%") | F.like(title, F.lit(r"%#00000001\__%"), F.lit("\\")) | F.like(title, F.lit(r"%00012\_\%"), F.lit("\\"))
    return table(spark, sf_dir, "customer").where(hit).select("c_custkey")


@query(r"""
WITH f AS (SELECT page_id, split_part(url, '/', 3) AS host, regexp_matches(url, '^https://') AS secure, regexp_matches(coalesce(regexp_extract(url, '/([a-z]{2})/', 1), ''), '^[a-z]{2}$') AS region FROM pages)
SELECT page_id, secure, region, count(*) OVER (PARTITION BY host) = 1 AS alone FROM f""")
def r_fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints on each row (an https source, a region code) and over rows (a host of its own)."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.startswith("url", F.lit("https://")).alias("secure"), (F.regexp_extract("url", "/([a-z]{2})/", 1) != "").alias("region"))
    hosts = rows.groupBy("host").agg((F.count("*") == 1).alias("alone"))
    return rows.join(hosts, "host").select("page_id", "secure", "region", "alone")


@query("SELECT event_id, k FROM (SELECT event_id, try_cast(json_extract_string(CASE WHEN event_id % 4 = 0 THEN left(props, 5) ELSE props END, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(CASE WHEN event_id % 4 = 0 THEN left(props, 5) ELSE props END)) WHERE k >= 10 AND k <= 90")
def r_sound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can be read and are of the right shape; the rest is dropped."""
    props = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(props, "k long").getField("k").alias("k")).where("k BETWEEN 10 AND 90")


@query("SELECT lower(trim(c_mktsegment)) AS name, count(*) AS n, min(c_custkey) AS first_id FROM customer GROUP BY 1 HAVING count(*) > 1")
def r_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several rows share when case, accents and spaces don't count."""
    return table(spark, sf_dir, "customer").groupBy(F.trim(tx.fold(F.col("c_mktsegment"))).alias("name")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id")).where("n > 1")


@query("""
SELECT user_id, list_element(['AUTO', 'CONFIRM', 'DENY'], 1 + max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END)) AS decision,
  bool_or(event_type IN ('purchase', 'signup')) AS approval FROM events WHERE event_id % 9 = 0 OR event_type <> 'error' GROUP BY user_id""")
def r_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most restrictive decision over a user's scopes; unknown scopes deny."""
    kind = F.col("event_type")
    rank = F.when(kind.isin("view", "click"), 0).when(kind.isin("purchase", "signup"), 1).otherwise(2)
    name = F.element_at(F.array(F.lit("AUTO"), F.lit("CONFIRM"), F.lit("DENY")), F.max(rank) + 1)
    rows = table(spark, sf_dir, "events").where("event_id % 9 = 0 OR event_type <> 'error'")
    return rows.groupBy("user_id").agg(name.alias("decision"), F.bool_or(kind.isin("purchase", "signup")).alias("approval"))


@query("""
SELECT c_custkey, coalesce(n.n_name, r.r_name, 'DEFAULT') AS role FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_nationkey % 3 = 0 LEFT JOIN nation m ON m.n_nationkey = c_nationkey LEFT JOIN region r ON r.r_regionkey = m.n_regionkey AND r.r_regionkey % 2 = 0""")
def r_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role from the nation if it has one, else from its region, else the default."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region.where("r_regionkey % 2 = 0"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("own"), "r_name")
    joined = table(spark, sf_dir, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce("own", "r_name", F.lit("DEFAULT")).alias("role"))


@query("SELECT c_custkey, ('0x' || left(sha256(c_name), 2))::INT % 2 = 0 AS swapped, left(sha256(c_custkey || '|' || c_name), 16) AS seal FROM customer")
def r_blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two answers comes first, by the parity of a digest's first byte, and a seal of the row."""
    byte = F.conv(F.substring(F.sha2("c_name", 256), 1, 2), 16, 10).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", (byte % 2 == 0).alias("swapped"), F.substring(F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"), 256), 1, 16).alias("seal"))


@query(f"""
WITH books AS (SELECT doc_id // 20 AS book, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY 1),
a AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000 + book, text FROM books
  UNION ALL SELECT 2000000 + book, left(text, length(text) - 30) || ' another end.' FROM books),
d AS (SELECT min(doc_id) AS id, any_value(text) AS text
  FROM (SELECT doc_id, text, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS print FROM a) GROUP BY print),
c AS (SELECT id, generate_subscripts(c, 1) AS pos, unnest(c) AS chunk FROM (SELECT id, {SQL_CHUNKS} AS c FROM d)),
h AS (SELECT id, h, row_number() OVER (PARTITION BY id, h ORDER BY pos) AS copy
  FROM (SELECT id, pos, sha256(trim(regexp_replace(chunk, '\\s+', ' ', 'g'), ' ')) AS h FROM c)),
n AS (SELECT id, count(*) AS n FROM h GROUP BY id)
SELECT a, b, share FROM (
  SELECT x.id AS a, y.id AS b, count(*) / greatest(any_value(nx.n), any_value(ny.n)) AS share
  FROM h x JOIN h y ON x.h = y.h AND x.copy = y.copy AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY x.id, y.id)
WHERE share >= 0.9""")
def u_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different documents that share nine tenths of their chunks, copies counted: the documents, books of twenty each, and books with another end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    books = docs.groupBy(F.floor(F.col("doc_id") / 20).alias("book")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    other = F.concat(F.substring("text", F.lit(1), F.length("text") - 30), F.lit(" another end."))
    known = docs.unionByName(books.select((F.col("book") + 1_000_000).alias("doc_id"), "text")).unionByName(books.select((F.col("book") + 2_000_000).alias("doc_id"), other.alias("text")))
    return en.similar_documents(known, "doc_id", "text")


@query()
def h_without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions' best 20 by field counts without copied articles (no SQL; brute force in the tests)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    terms = rk.content_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    ranked = rk.top_k(rk.field_weighted_tf(docs, terms, "doc_id", "title", "text"), 20)
    full = ranked.join(docs.select(F.col("doc_id").alias("doc"), "title", F.col("text").alias("body")), "doc")
    return en.without_copies(full)
