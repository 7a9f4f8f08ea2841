"""Queries of stored tables (imports that decide by content, rows replaced by parent, ledgers), route sweeps, and alphabetical order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import aggregates as ag
from evispark.plans.registry import query, table
from evispark.plans.texts import SQL_CHUNKS
from evispark.session import shared_folder
from evispark.sources import library as lib
from evispark.sources import versions as vs

#: Books: the texts of twenty documents each. First come the even documents and books; then the odd documents, every book
#: with another end, and every book with other white space.
_INCOMING = """
books AS (SELECT doc_id // 20 AS book, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY 1),
incoming AS (
  SELECT doc_id % 2 AS batch, doc_id AS id, text FROM documents UNION ALL
  SELECT 0, 1000000 + book, text FROM books WHERE book % 2 = 0 UNION ALL
  SELECT 1, 2000000 + book, left(text, length(text) - 30) || ' another end.' FROM books UNION ALL
  SELECT 1, 3000000 + book, replace(text, ' ', '  ') FROM books)"""


def _incoming(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The rows of all batches; the books are put together once, at ``path``."""
    docs = table(spark, sf_dir, "documents")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    books = docs.groupBy(F.floor(F.col("doc_id") / 20).alias("book")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    books.write.parquet(path)
    books = spark.read.schema(books.schema).parquet(path)
    as_id = lambda base: (F.lit(base) + F.col("book")).alias("doc_id")
    longer = F.concat(F.substring("text", F.lit(1), F.length("text") - 30), F.lit(" another end."))
    return (
        docs.select((F.col("doc_id") % 2).alias("batch"), "doc_id", "text")
        .unionByName(books.where("book % 2 = 0").select(F.lit(0).alias("batch"), as_id(1_000_000), "text"))
        .unionByName(books.select(F.lit(1).alias("batch"), as_id(2_000_000), longer.alias("text")))
        .unionByName(books.select(F.lit(1).alias("batch"), as_id(3_000_000), F.replace("text", F.lit(" "), F.lit("  ")).alias("text")))
    )


@query(f"""
WITH {_INCOMING},
printed AS (SELECT *, CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) END AS print FROM incoming),
placed AS (SELECT *, first_value(id) OVER (PARTITION BY print ORDER BY batch, id) AS first FROM printed),
cut AS (SELECT batch, id, {SQL_CHUNKS} AS c FROM placed WHERE print IS NOT NULL AND first = id),
chunks AS (SELECT batch, id, generate_subscripts(c, 1) AS pos, unnest(c) AS chunk FROM cut),
keys AS (SELECT batch, id, h, row_number() OVER (PARTITION BY id, h ORDER BY pos) AS copy, count(*) OVER (PARTITION BY id) AS n
  FROM (SELECT batch, id, pos, sha256(trim(regexp_replace(chunk, '\\s+', ' ', 'g'), ' ')) AS h FROM chunks)),
pairs AS (SELECT a.id, b.batch, b.id AS other, count(*) / greatest(any_value(a.n), any_value(b.n)) AS share
  FROM keys a JOIN keys b ON a.h = b.h AND a.copy = b.copy AND (b.batch < a.batch OR b.batch = a.batch AND b.id < a.id) GROUP BY 1, 2, 3),
best AS (SELECT id, other, share FROM pairs WHERE share >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, batch, other) = 1)
SELECT p.batch, p.id AS doc_id, CASE WHEN print IS NULL THEN 'empty' WHEN first <> p.id THEN 'same' WHEN other IS NOT NULL THEN 'similar' ELSE 'new' END AS decision,
  CASE WHEN print IS NULL THEN NULL WHEN first <> p.id THEN first ELSE other END AS other, round(CASE WHEN first = p.id THEN share END, 6) AS share
FROM placed p LEFT JOIN best USING (id)""")
def x_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a library decides on two batches; the second comes twice, which changes nothing."""
    path = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    incoming = _incoming(spark, sf_dir, f"{path}-books")
    for number in (0, 1, 1):
        lib.import_batch(spark, path, incoming.where(F.col("batch") == number), number)
    return lib.decisions(spark, path).select("batch", "doc_id", "decision", "other", F.round("share", 6).alias("share"))


_PRINT = "CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) END"


@query(f"""
WITH p AS (SELECT source AS collection, doc_id, {_PRINT} AS print FROM documents),
t AS (SELECT *, CASE WHEN print IS NOT NULL THEN first_value(doc_id) OVER (PARTITION BY print ORDER BY collection NULLS FIRST, doc_id) END AS first FROM p)
SELECT collection, doc_id, print, nullif(first, doc_id) AS twin_of FROM t WHERE doc_id % 3 <> 0 OR collection IS NULL""")
def x_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents that are stored as chunks only (two thirds of them have none yet), and their twins."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "collection")
    body = F.concat(F.lit("(read from a picture)\n\n"), F.regexp_replace("text", r"^\s+|\s+$", ""))
    noted = F.when(F.col("doc_id") % 4 == 0, body).otherwise(F.col("text"))
    chunks = docs.select("collection", "doc_id", F.posexplode(tx.chunks(noted)).alias("pos", "body"))
    return lib.backfill(chunks, docs.where("doc_id % 3 = 0"), notes=["(read from a picture)\n\n"])


@query("""
SELECT user_id, event_id, event_type FROM events
WHERE CASE WHEN user_id % 10 = 7 THEN false WHEN user_id % 3 = 0 THEN event_type = 'purchase' AND (user_id % 2 = 1 OR value < 30) ELSE true END""")
def x_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user after three writes: all; purchases only for every third user, and none for those ending in 7; cheaper ones for some of the former."""
    path = f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    bought = events.where("event_type = 'purchase' AND user_id % 3 = 0 AND user_id % 10 <> 7")
    vs.replace_children(spark, path, events, "user_id")
    vs.replace_children(spark, path, bought, "user_id", gone=events.where("user_id % 10 = 7 OR user_id % 3 = 0").select("user_id").distinct())
    for _ in range(2):  # the same write again changes nothing
        cheap = events.where("event_type = 'purchase' AND user_id % 6 = 0 AND user_id % 10 <> 7 AND value < 30")
        vs.replace_children(spark, path, cheap, "user_id", gone=bought.where("user_id % 2 = 0").select("user_id"), number=3)
    return vs.current(spark, path, "user_id").select("user_id", "event_id", "event_type")


@query("""
SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents) a
WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 40 = 1 AND b.source IS NOT DISTINCT FROM a.source AND b.lang IS NOT DISTINCT FROM a.lang)""")
def t_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages of the corpus that a part of it lacks."""
    docs = table(spark, sf_dir, "documents")
    return vs.lost_from(docs, docs.where("doc_id % 40 = 1"), ["source", "lang"])


#: Where an event should go and where it went.
_ROUTES = """
SELECT event_type AS family, CASE WHEN value < 10 THEN 'tool' WHEN value < 25 THEN 'model' ELSE 'chat' END AS expected,
  CASE WHEN (event_id * 7) % 20 < 3 THEN 'model' WHEN (event_id * 7) % 20 = 3 THEN 'chat' WHEN value < 10.5 THEN 'tool' WHEN value < 25 THEN 'model' ELSE 'chat' END AS routed FROM events"""


@query(f"""
SELECT family, expected, routed, count(*) AS total, count(*) FILTER (expected = routed) AS ok, count(*) FILTER (expected <> routed AND routed = 'model') AS to_model,
  count(*) FILTER (expected <> routed AND routed = 'chat') AS to_chat, count(*) FILTER (expected <> routed AND routed = 'tool') AS wrong_route
FROM ({_ROUTES}) GROUP BY GROUPING SETS ((family), (expected, routed), ())""")
def a_router_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep of routes: by family, as a table of what was expected and what came, and in all."""
    events = table(spark, sf_dir, "events")
    value, k = F.col("value"), (F.col("event_id") * 7) % 20
    band = lambda least: F.when(value < least, "tool").when(value < 25, "model").otherwise("chat")
    cases = events.select(F.col("event_type").alias("family"), band(10).alias("expected"), F.when(k < 3, "model").when(k == 3, "chat").otherwise(band(10.5)).alias("routed"))
    return ag.route_sweep(cases, "family", "expected", "routed", {"to_model": "model", "to_chat": "chat"})


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-Þà-öø-ÿ]+')) AS word FROM documents),
k AS (SELECT word, lower(strip_accents(word)) AS k FROM w)
SELECT left(k, 1) AS initial, min(word) AS word, count(*) AS spellings, row_number() OVER (PARTITION BY left(k, 1) ORDER BY k) AS rank FROM k GROUP BY k""")
def k_locale_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's words in alphabetical order, accents and case aside, and how many spellings each has."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÖØ-Þà-öø-ÿ]+"), F.lit(0))).alias("word")).distinct()
    return ag.locale_order(words, "word")
