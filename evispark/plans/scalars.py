"""Queries that apply the scalar functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import dates as dx
from evispark.functions import text as tx
from evispark.functions import vectors as vx
from evispark.plans.registry import query, sql_token_estimate, sql_tokens, table


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def f_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""
WITH w AS (SELECT DISTINCT unnest({sql_tokens("text")}) AS word FROM documents)
SELECT word,
  CASE WHEN length(word) < 4 OR word NOT LIKE '%s' OR regexp_matches(word, '(ss|is|us)$') THEN ''
       WHEN word LIKE '%ies' THEN left(word, length(word) - 3) || 'y'
       WHEN regexp_matches(word, '(s|x|z|o|ch|sh)es$') THEN left(word, length(word) - 2) || ',' || left(word, length(word) - 1)
       ELSE left(word, length(word) - 1) END AS singular,
  CASE WHEN length(word) >= 5 AND NOT regexp_matches(word, '[0-9]') THEN left(word, greatest(4, length(word) - 2)) END AS prefix
FROM w""")
def f_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.concat_ws(",", tx.singular_forms(F.col("word"))).alias("singular"), tx.prefix_form(F.col("word")).alias("prefix"))


_BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(ceil((n - 200) / 1800.0)::BIGINT, 1) END AS n_chunks, CASE WHEN n = 0 THEN 0 ELSE n + 200 * (greatest(ceil((n - 200) / 1800.0)::BIGINT, 1) - 1) END AS n_chars
  FROM (SELECT doc_id, length({_BODY}) AS n FROM documents)""")
def f_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.chunks(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query(f"SELECT doc_id, {sql_token_estimate('text')} AS estimate FROM documents")
def f_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("estimate"))


@query("SELECT print, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS print FROM documents) GROUP BY print")
def f_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates after white space is levelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("print"))
    return docs.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_BIGRAMS = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN len(w) >= 2 THEN {_BIGRAMS} ELSE [] END AS b FROM w),
p AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM b)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard,
  round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS contained FROM p WHERE a IS NOT NULL""")
def f_turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-bigram Jaccard and containment of each turn in the turn before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.word_bigrams(F.col("text")).alias("b"))
    pairs = turns.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(tx.containment(F.col("b"), F.col("a")), 6).alias("contained"))


_BARE = "html"
for _tag in ("script", "style", "noscript"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_BARE = f"regexp_replace(regexp_replace({_BARE}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'), ' ') AS text FROM pages")
def f_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages without their markup."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query(r"""
WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?…])\s+([\p{Lu}\p{N}¿¡"«])', '\1' || chr(1) || '\2', 'g') AS text FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\x01|\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM m)
SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s""")
def f_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the documents with its place."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(event_type, '^[a-z][a-z0-9_]{0,39}$') THEN event_type ELSE 'other' END AS label FROM events) GROUP BY label")
def f_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(tx.label(F.col("event_type")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant JSON: a broken cell is null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS b, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM p WHERE a IS NOT NULL""")
def v_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with the vector before it in its label."""
    rows = table(spark, sf_dir, "embeddings").withColumn("a", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("a IS NOT NULL")
    return rows.select("vec_id", F.round(vx.cosine(F.col("a"), F.col("embedding")), 6).alias("cosine"))


@query("""
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)
SELECT vec_id, list_sum(list_transform(e, lambda x: greatest(-127, least(127, floor(x / (CASE WHEN m > 0 THEN m / 127 ELSE 1 END) + 0.5)))::BIGINT))::BIGINT AS total, round(CASE WHEN m > 0 THEN m / 127 ELSE 1 END, 9) AS scale FROM s""")
def v_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("scale", vx.quantise_scale(F.col("embedding")))
    codes = vx.quantise(F.col("embedding"), F.col("scale"))
    return rows.select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.round("scale", 9).alias("scale"))


@query("SELECT o_orderkey, (SELECT min(d) FROM (SELECT unnest(generate_series(date_trunc('month', o_orderdate)::DATE, (date_trunc('month', o_orderdate) + INTERVAL 8 MONTH)::DATE, INTERVAL 1 DAY))::DATE AS d) WHERE d > o_orderdate::DATE AND day(d) = day(o_orderdate)) AS due FROM orders")
def d_next_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next date on the order's day of the month; months without it are skipped."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dx.next_monthly(day, day).alias("due"))


@query("""
SELECT o_orderkey, dayofweek(d)::INT AS weekday, d + ((1 - dayofweek(d) + 6 + 7) % 7 + 1)::INT AS next_monday, d - ((dayofweek(d) - 5 + 6 + 7) % 7 + 1)::INT AS last_friday
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def d_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dx.weekday(day).alias("weekday"), dx.next_weekday(day, 1).alias("next_monday"), dx.previous_weekday(day, 5).alias("last_friday"))


@query("""
SELECT o_orderkey, datediff('day', DATE '2024-03-01', (SELECT min(d) FROM (SELECT try_cast(printf('%04d-%02d-%02d', y, month(o_orderdate), day(o_orderdate)) AS DATE) AS d FROM generate_series(2024, 2032) AS t(y)) WHERE d >= DATE '2024-03-01')) AS days FROM orders""")
def d_anniversary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from 1 March 2024 to the next anniversary of the order; 29 February waits for a leap year."""
    today = F.lit("2024-03-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(dx.next_anniversary(F.col("o_orderdate").cast("date"), today), today).cast("long").alias("days"))


@query("SELECT event_id, CASE WHEN (epoch_us(ts) % 23000000 + 23000000) % 23000000 < 18000000 THEN 'press' WHEN (epoch_us(ts) % 23000000 + 23000000) % 23000000 < 22000000 THEN 'breathe' ELSE 'switch' END AS phase FROM events")
def d_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", dx.cycle_phase(millis, [("press", 18000), ("breathe", 4000), ("switch", 1000)]).alias("phase"))
