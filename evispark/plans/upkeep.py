"""Queries of upkeep and checking: rules, retention, transfers, codecs, bids, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import ranking as rk
from evispark.plans import retrieval as rt
from evispark.plans.registry import query, table
from evispark.plans.texts import SQL_CHUNKS, f_chunk_texts


@query("""
WITH rules(priority, kind, least, decision) AS (VALUES (1, 'error', 20, 'deny'), (2, 'purchase', 30, 'ask'), (3, 'purchase', 0, 'allow'), (4, 'view', 0, 'allow'), (5, 'click', 5, 'allow'))
SELECT event_id, coalesce((SELECT decision FROM rules r WHERE r.kind = e.event_type AND e.value >= r.least ORDER BY priority LIMIT 1), 'deny') AS decision FROM events e""")
def r_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule by priority that fits an event decides; without one it is denied."""
    rows = [(1, "error", 20, "deny"), (2, "purchase", 30, "ask"), (3, "purchase", 0, "allow"), (4, "view", 0, "allow"), (5, "click", 5, "allow")]
    rules = spark.createDataFrame(rows, "priority int, kind string, least int, decision string")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    fit = events.join(F.broadcast(rules), (F.col("event_type") == F.col("kind")) & (F.col("value") >= F.col("least")))  # five rules
    first = fit.groupBy("event_id").agg(F.min_by("decision", "priority").alias("decision"))
    return events.select("event_id").join(first, "event_id", "left").select("event_id", F.coalesce("decision", F.lit("deny")).alias("decision"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def t_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring buffer of the newest hundred (the limit is the feature)."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT -1 OFFSET 500)".replace("LIMIT -1 ", ""))
def t_beyond_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the retention of the newest five hundred deletes: all that lies before the five-hundredth."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")
    return events.join(newest, "event_id", "left_anti").select("event_id")


@query(f"""
WITH c AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, len(c) AS n, unnest(c) AS chunk FROM (SELECT doc_id, {SQL_CHUNKS} AS c FROM documents)),
g AS (SELECT * FROM c WHERE (doc_id + pos) % 17 <> 0)
SELECT doc_id, any_value(n) AS n, CASE WHEN count(*) = any_value(n) THEN sha256(string_agg(chunk, '' ORDER BY pos)) END AS print,
  CASE WHEN count(*) < any_value(n) THEN (SELECT min(i) FROM (SELECT unnest(range(0, any_value(g.n))) AS i) WHERE (doc_id + i) % 17 = 0) END AS next_missing FROM g GROUP BY doc_id""")
def r_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers in parts, some of which are lost: whole ones are put together, of the others the first missing part is named."""
    parts = f_chunk_texts(spark, sf_dir)
    total = parts.groupBy("doc_id").agg(F.count("*").alias("n"))
    got = parts.where((F.col("doc_id") + F.col("pos")) % 17 != 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("p"))
    have = F.transform("p", lambda x: x["pos"])
    missing = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), have))
    whole = F.sha2(F.array_join(F.transform("p", lambda x: x["chunk"]), ""), 256)
    return got.join(total, "doc_id").select("doc_id", "n", F.when(F.size("p") == F.col("n"), whole).alias("print"), missing.alias("next_missing"))


@query(f"""{rt._BM25}, b AS (SELECT q, coalesce(source, '') AS source, matched, score, doc, row_number() OVER (PARTITION BY q, coalesce(source, '') ORDER BY matched DESC, score DESC, doc) AS r FROM gated LEFT JOIN documents ON doc_id = doc)
SELECT q, source, doc, matched, row_number() OVER (PARTITION BY q ORDER BY matched DESC, score DESC, doc) = 1 AS winner FROM b WHERE r = 1""")
def h_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's best document for a question, by words covered, then by score; and which of them wins."""
    found = rt._gated(*rt._scored(spark, sf_dir)).select("q", "doc", "matched", "score")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("source", F.lit("")).alias("source"))
    bid = F.struct("matched", "score", (-F.col("doc")).alias("doc"))
    bids = found.join(sources, "doc", "left").groupBy("q", F.coalesce("source", F.lit("")).alias("source")).agg(F.max(bid).alias("b"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("b"))) == 1  # one row for each source
    return bids.select("q", "source", (-F.col("b.doc")).alias("doc"), F.col("b.matched").alias("matched"), best.alias("winner"))


@query(f"""{rt._BM25}, t AS ({rt._top('gated', 3, 'q, doc')}),
hit AS (SELECT item_id, coalesce(bool_or(contains(lower(text2), lower(text))), false) AS hit FROM (SELECT item_id, b.text, d.text AS text2 FROM benchmark b LEFT JOIN t ON t.q = item_id LEFT JOIN documents d ON d.doc_id = t.doc) GROUP BY item_id)
SELECT count(*) AS n, sum(hit::INT)::BIGINT AS hits, avg(hit::INT) >= 0.9 AS passed FROM hit""")
def h_title_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in one of their best three documents, and whether nine tenths do."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.lower("text").alias("wanted"))
    best = rk.top_k(rt._gated(*rt._scored(spark, sf_dir)), 3).select("q", "doc")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("said"))
    hit = F.coalesce(F.bool_or(F.contains("said", "wanted")), F.lit(False)).cast("int")
    each = items.join(best, "q", "left").join(docs, "doc", "left").groupBy("q").agg(hit.alias("hit"))
    return each.agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), (F.avg("hit") >= 0.9).alias("passed"))


@query("""
WITH v AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x AS DOUBLE))) AS v FROM documents)
SELECT doc_id, len(list_filter(v, lambda x: x IS NOT NULL)) AS n, len(list_filter(v, lambda e: abs(e - 12) <= 0.5 + 1e-9)) > 0 AS twelve,
  len(list_filter(v, lambda e: abs(e - 2.1) <= 0.05 + 1e-9 OR abs(e / 1e3 - 2.1) <= 0.05 + 1e-9 OR abs(e / 1e6 - 2.1) <= 0.05 + 1e-9 OR abs(e / 1e9 - 2.1) <= 0.05 + 1e-9 OR abs(e / 1e12 - 2.1) <= 0.05 + 1e-9)) > 0 AS scaled FROM v""")
def f_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct numbers of a text, and whether 12 and 2.1 (also as thousands to billions) round from one of them."""
    numbers = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("double"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", numbers.alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), tx.rounds_from(F.lit(12.0), 0, F.col("v")).alias("twelve"), tx.rounds_from(F.lit(2.1), 1, F.col("v")).alias("scaled"))


@query("SELECT event_id, CASE WHEN event_id % 10 <= 0 THEN '-' ELSE replace(printf('%.1f', floor(value / (event_id % 10) * 10 + 0.5) / 10), '.', ',') END AS rate, strftime(ts, '%d/%m/%Y %H:%M') AS said, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS flag FROM events")
def f_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with a decimal comma (a dash without a duration), dates with a clock, and three-valued flags from 0, 1 and nothing."""
    k = F.col("event_id") % 10
    rate = F.when(k <= 0, "-").otherwise(F.replace(F.format_string("%.1f", F.floor(F.try_divide(F.col("value"), k) * 10 + 0.5) / 10), F.lit("."), F.lit(",")))
    stored = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 0)
    return table(spark, sf_dir, "events").select("event_id", rate.alias("rate"), F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm").alias("said"), (stored == 1).cast("string").alias("flag"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN array_to_string(string_split(text, ' '), '|') WHEN 1 THEN '' WHEN 2 THEN text END AS codes FROM conversations""")
def f_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of texts: a turn's words, none, or the whole turn; an object or an array that is cut off is null."""
    k = F.col("turn") % 4
    whole = F.to_json(F.split("text", " "))
    cell = F.when(k == 0, whole).when(k == 1, "[]").when(k == 2, F.to_json(F.array("text"))).when(F.col("conv_id") % 2 == 0, F.to_json(F.struct("text"))).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.from_json(cell, "array<string>"), "|").alias("codes"))


_RECORD = ("CASE event_id % 7 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN '{\"user\": ' ELSE '{\"secret\":\"x\",\"user\":' || CASE event_id % 3 WHEN 0 THEN '7' ELSE '{\"id\":' || user_id || ',\"name\":\"n\"}' END"
           " || ',\"props\":' || props || ',\"items\":[{\"n\":' || value || ',\"p\":5},{\"p\":2},3]}' END")  # fmt: skip


@query(f"""
WITH r AS (SELECT event_id, {_RECORD} AS record FROM events),
j AS (SELECT event_id, CASE WHEN json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT' THEN record::JSON END AS j FROM r)
SELECT event_id, CASE WHEN j IS NOT NULL THEN '{{' || CASE WHEN json_exists(j, '$.user.id') THEN '"user":{{"id":' || json_extract_string(j, '$.user.id') || '}},' ELSE '' END
  || '"props":{{"k":' || json_extract_string(j, '$.props.k') || '}},"items":[{{"n":' || regexp_replace(json_extract_string(j, '$.items[0].n'), '\\.0$', '') || '}},{{}},null]}}' END AS shown FROM j""")
def f_disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut down to the paths that may be shown; missing paths are skipped, lists and broken records show nothing."""
    record = F.expr(_RECORD.replace("user_id", "cast(user_id AS string)").replace("|| value ||", "|| cast(value AS string) ||"))
    return table(spark, sf_dir, "events").select("event_id", tx.disclosed(record, ["user.id", "props.k", "items[].n", "none.at"]).alias("shown"))


_LOOPED = "coalesce(text, '') || repeat(CASE WHEN doc_id % 5 = 0 THEN ' one, two and so on;' ELSE ' and so on' END, (doc_id % 12)::INT) || CASE WHEN doc_id % 9 = 4 THEN chr(10) || repeat('ab|', 50) WHEN doc_id % 9 = 5 THEN '```x' || repeat(' so', 40) WHEN doc_id % 9 = 6 THEN '```tool ' || repeat(' so', 40) ELSE '' END"


@query(rf"""
WITH t AS (SELECT doc_id, {_LOOPED} AS text FROM documents),
f AS (SELECT *, right(text, 2000) AS tail, len(string_split(text, '```')) - 1 AS fences, string_split(text, '```')[-1] AS last FROM t),
u AS (SELECT *, unnest(range(2, least(160, length(tail) // 3) + 1)) AS unit FROM f WHERE length(text) >= 80 AND (fences % 2 = 0 OR regexp_matches(last, '\A(tool)(\s|\z)'))),
s AS (SELECT *, CASE WHEN unit >= 40 THEN 3 ELSE greatest(4, ceil(80 / unit))::INT END AS least FROM u),
fit AS (SELECT *, right(tail, unit) AS word FROM s WHERE unit * least <= length(tail)
  AND right(tail, unit * (least - 1)::BIGINT) = left(right(tail, unit * least), unit * (least - 1)::BIGINT)),
best AS (SELECT * FROM fit WHERE NOT contains(word, '|') AND regexp_matches(word, '\p{{L}}') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY unit) = 1),
k AS (SELECT *, list_max(list_filter(range(least, length(tail) // unit + 1), lambda c: right(tail, c * unit) = repeat(word, c))) AS copies FROM best)
SELECT doc_id, (length(text) - copies * unit + unit)::INT AS keep, unit::INT AS unit, copies::INT AS copies FROM k""")
def f_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text's end falls into a loop."""
    text = F.expr(_LOOPED.replace("chr(10)", "'\\n'").replace("(doc_id % 12)::INT", "cast(doc_id % 12 AS int)"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.repetition(text).alias("loop")).where("loop IS NOT NULL").select("doc_id", "loop.*")
