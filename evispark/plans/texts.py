"""Queries over texts, dates, units and vectors that return the functions' whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import dates as dx
from evispark.functions import text as tx
from evispark.functions import units as ux
from evispark.functions import vectors as vx
from evispark.operators import entities as en
from evispark.operators.sizes import small
from evispark.plans.registry import query, sql_tokens, table


@query(f"SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def f_token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its place."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


_BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
SQL_CHUNKS = f"CASE WHEN length({_BODY}) > 0 THEN list_transform(generate_series(0, greatest(ceil((length({_BODY}) - 200) / 1800.0)::INT - 1, 0)), lambda i: substr({_BODY}, i * 1800 + 1, 2000)) ELSE [] END"


@query(f"SELECT doc_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS chunk FROM (SELECT doc_id, {SQL_CHUNKS} AS c FROM documents)")
def f_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(f"SELECT doc_id, sha256({_BODY}) AS print FROM documents")
def f_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their chunks, in order."""
    pieces = f_chunk_texts(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda p: p["chunk"]).alias("pieces"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(pieces, "doc_id", "left")
    return docs.select("doc_id", F.sha2(F.coalesce(tx.stitched("pieces"), F.lit("")), 256).alias("print"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents),
s AS (SELECT word, coalesce(list_filter(['ations', 'ation', 'ings', 'ing', 'ies', 'ied', 'edly', 'ed', 'es', 's', 'ciones', 'cion', 'mente', 'amente', 'coes', 'cao'],
  lambda x: suffix(word, x) AND length(word) - length(x) >= 4)[1], '') AS cut FROM w WHERE word <> '')
SELECT word, left(left(word, length(word) - length(cut)), 7) AS stem FROM s""")
def f_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


@query(r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS page FROM documents),
i AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(split_part(text, '.', 1))), '[^a-z0-9]+', ' ', 'g'), ' ') AS quote FROM benchmark)
SELECT doc_id, item_id FROM d, i WHERE quote <> '' AND contains(page, ' ' || quote || ' ')""")
def f_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that quote the first sentence of an item: those that have its first three words in a row, and then the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("quote"))
    start = lambda words, n: F.array_join(F.slice(words, 1, n), " ")
    asked = small(items.withColumn("key", start(F.split(tx.plain_words(F.col("quote")), " "), 3)).where("key <> ''"))
    words = F.split(tx.plain_words(F.col("text")), " ")
    runs = lambda w: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.array_join(F.slice(w, i, n), " ")))))
    met = docs.select("doc_id", F.explode(F.flatten(F.transform(F.array(words), runs))).alias("key")).join(asked, "key").select("doc_id", "item_id", "quote")
    return met.join(docs, "doc_id").where(tx.quote_present(F.col("text"), F.col("quote"))).select("doc_id", "item_id")


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark)
SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word) AS distance FROM w a JOIN w b ON left(a.word, 2) = left(b.word, 2) AND a.word < b.word AND length(a.word) > 1
WHERE levenshtein(a.word, b.word) <= 2""")
def f_close_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the items that begin with the same two letters and are at most two edits apart: they meet where both have the same after up to two deletions."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) > 1").distinct()
    return en.close_words(words, "word", most=2, head=2)


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, ' (the|de|la|der) ', ' </untrusted > ', 'g'), ' (and|y|e|und) ', ' < UNTRUSTED x><b> ', 'g'), '<(\s*/?\s*untrusted)', chr(8249) || '\1', 'gi')) AS safe FROM documents")
def f_neutralised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tags for some of their words, made safe."""
    tagged = F.regexp_replace(F.regexp_replace("text", " (the|de|la|der) ", " </untrusted > "), " (and|y|e|und) ", " < UNTRUSTED x><b> ")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.neutralised(tagged), 256).alias("safe"))


@query("SELECT event_id, 4 AS n, event_type AS one, props || ', ' || user_id AS two, value::VARCHAR AS three, CASE event_id % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END AS mark FROM events")
def f_csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines with one of three delimiters, quotes around JSON, delimiters in quotes and spaces, taken apart."""
    mark = F.when(F.col("event_id") % 3 == 0, ",").when(F.col("event_id") % 3 == 1, ";").otherwise("|")
    quoted = F.concat(F.lit('"'), F.replace(F.concat("props", F.lit(", "), F.col("user_id").cast("string")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col("event_type"), F.lit(" "), mark, F.lit(" "), quoted, mark, F.col("value").cast("string"), mark, F.lit(" x"), F.lit("y"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line"), mark.alias("given"), tx.delimiter(F.concat_ws("", F.array_repeat(mark, 4))).alias("mark"))
    fields = F.when(F.col("given") == ",", tx.csv_fields(F.col("line"))).when(F.col("given") == ";", tx.csv_fields(F.col("line"), ";")).otherwise(tx.csv_fields(F.col("line"), "|"))
    return rows.select("event_id", fields.alias("f"), "mark").select("event_id", F.size("f").alias("n"), F.col("f")[0].alias("one"), F.col("f")[1].alias("two"), F.col("f")[2].alias("three"), "mark")


@query("SELECT p_partkey, p_partkey // 100 * 10000 + p_partkey % 100 > p_size * 10000 + 7 AS newer FROM part")
def f_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions compared as numbers."""
    mine = F.concat(F.lit("v"), F.floor(F.col("p_partkey") / 100), F.lit("."), F.col("p_partkey") % 100)
    other = F.concat(F.col("p_size"), F.lit(".7"))
    return table(spark, sf_dir, "part").select("p_partkey", (tx.version_key(mine) > tx.version_key(other)).alias("newer"))


_WALK = """
fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS size, 0::BIGINT AS pos, ''::VARCHAR AS part FROM parts
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN {full} THEN 0 ELSE f.size END + length(p.part) + 1, f.pos + ({full})::INT, p.part FROM fold f JOIN parts p ON p.doc_id = f.doc_id AND p.i = f.i + 1)"""


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
parts AS (SELECT doc_id, generate_subscripts(l, 1) AS i, left(unnest(l), 300) AS part FROM l), {_WALK.format(full="f.i > 0 AND f.size + length(p.part) + 1 > 300")}
SELECT doc_id, pos, string_agg(part, chr(10) ORDER BY i) AS piece FROM fold WHERE i > 0 GROUP BY doc_id, pos""")
def f_packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines packed into pieces of at most 300 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.packed_lines(F.split("text", "\n"), 300).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda p: regexp_extract_all(p, '[^.!?]+(?:[.!?]+["'')\\]]*|$)\\s*'))),
    lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents),
parts AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS part FROM s), {_WALK.format(full="f.i > 0 AND f.size + length(p.part) > 600")},
pieces AS (SELECT doc_id, pos, string_agg(part, ' ' ORDER BY i) AS piece FROM fold WHERE i > 0 GROUP BY doc_id, pos),
few AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM pieces WHERE pos < 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, piece FROM few WHERE length(piece) >= 40 OR pos = last""")
def f_intro_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of each document in up to three pieces of sentences."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.intro_chunks(F.col("text")).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (
  SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, turn + 1000, translate(text, 'aeiouäé', 'AEIOUÄÉ') || '!' FROM conversations) WHERE regexp_matches(text, '[A-Za-z]'))
SELECT conv_id, turn, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, slug ORDER BY turn) AS n FROM c)""")
def f_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the words of a turn, with -2, -3 where a conversation has the same again (every turn comes a second time, louder)."""
    slug = F.trim(F.regexp_replace(tx.fold(F.col("text")), "[^a-z0-9]+", "-"), F.lit("-"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    again = turns.select("conv_id", (F.col("turn") + 1000).alias("turn"), F.concat(F.translate("text", "aeiouäé", "AEIOUÄÉ"), F.lit("!")).alias("text"))
    rows = turns.unionByName(again).where(F.col("text").rlike("[A-Za-z]")).select("conv_id", "turn", slug.alias("slug"))
    n = F.row_number().over(Window.partitionBy("conv_id", "slug").orderBy("turn"))
    return rows.select("conv_id", "turn", F.concat("slug", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")).alias("id"))


@query(r"""
WITH c AS (SELECT event_id, list_sort(list_distinct(list_filter([event_id % 9, event_id % 5, (value * 10)::BIGINT % 7], lambda x: x >= 1 AND x <= 6))) AS cited FROM events)
SELECT event_id, array_to_string(cited, ',') AS cited, array_to_string(list_transform(cited, lambda x: list_position(cited, x)), ',') AS renumbered FROM c""")
def f_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sources 1 to 6, once each in ascending order, and their new numbers."""
    numbers = F.array(F.col("event_id") % 9, F.col("event_id") % 5, F.bround(F.col("value") * 10).cast("long") % 7)
    rows = table(spark, sf_dir, "events").select("event_id", F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= 6)))).alias("c"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("event_id", text(F.col("c")).alias("cited"), text(F.transform("c", lambda x, i: i + 1)).alias("renumbered"))


@query("SELECT user_id, array_to_string(list_sort(list_filter(range(0, 24), lambda h: NOT list_contains(list(DISTINCT hour(ts)), h))), ',') AS missing, count(DISTINCT hour(ts)) / 24 AS progress FROM events GROUP BY user_id")
def f_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of the day in which a user did nothing, and the share of those done."""
    done = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.hour("ts")).alias("done"))  # 24 at most
    left = F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("done"))
    return done.select("user_id", F.array_join(F.transform(left, lambda h: h.cast("string")), ",").alias("missing"), (F.size("done") / 24).alias("progress"))


@query("""
WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, '  ' || translate(text, 'aeiouäé', 'AEIOUÄÉ') FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(strip_accents(trim(text, ' '))) ORDER BY doc_id) AS r FROM a) WHERE r = 1""")
def f_first_by_folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the documents whose whole texts fold to the same; a third come again with capital vowels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    louder = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat(F.lit("  "), F.translate("text", "aeiouäé", "AEIOUÄÉ")).alias("text"))
    first = docs.unionByName(louder).groupBy(tx.fold(F.trim("text")).alias("k")).agg(F.min(F.struct("doc_id", "text")).alias("x"))
    return first.select("x.doc_id", "x.text")


_UNITS = "list_element(['km', 'Millas', 'foot', 'kg', 'onzas', 'ml', 'cups', 'horas', 'min', '°C', 'fahrenheit', 'K', 'parsec'], 1 + (event_id % 13)::INT)"


@query(f"""
WITH u(name, cat, f, o) AS (VALUES ('km', 'length', 1000.0::DOUBLE, 0.0::DOUBLE), ('millas', 'length', 1609.344, 0), ('foot', 'length', 0.3048, 0), ('kg', 'weight', 1, 0), ('onzas', 'weight', 0.028349523125, 0), ('ml', 'volume', 0.001, 0),
  ('cups', 'volume', 0.2365882365, 0), ('horas', 'time', 3600, 0), ('min', 'time', 60, 0), ('c', 'temperature', 1, 0), ('fahrenheit', 'temperature', 5.0::DOUBLE / 9, -32), ('k', 'temperature', 1, -273.15)),
e AS (SELECT event_id, value * 20 - 300 AS x, replace(lower({_UNITS}), '°', '') AS a, replace(lower({_UNITS.replace('event_id', '(event_id // 13 + event_id % 13)')}), '°', '') AS b FROM events)
SELECT event_id, round(CASE WHEN ua.cat = ub.cat AND NOT (ua.cat = 'temperature' AND (x + ua.o) * ua.f < -273.15 - 1e-9) THEN (x + ua.o) * ua.f / ub.f - ub.o END, 6) AS converted,
  CASE WHEN ua.f IS NULL OR ub.f IS NULL THEN 'unknown' WHEN ua.cat <> ub.cat THEN 'mismatch' WHEN ua.cat = 'temperature' AND (x + ua.o) * ua.f < -273.15 - 1e-9 THEN 'cold' END AS error
FROM e LEFT JOIN u ua ON ua.name = a LEFT JOIN u ub ON ub.name = b""")
def f_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between units of length, weight, volume, time and temperature."""
    names = F.array(*[F.lit(x) for x in ("km", "Millas", "foot", "kg", "onzas", "ml", "cups", "horas", "min", "°C", "fahrenheit", "K", "parsec")])
    pick = lambda n: F.element_at(names, (F.pmod(n, F.lit(13)) + 1).cast("int"))
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 20 - 300).alias("x"), pick(n).alias("a"), pick(F.floor(n / 13) + n % 13).alias("b"))
    return ux.convert(rows, "x", "a", "b").select("event_id", F.round("converted", 6).alias("converted"), "error")


@query("""
SELECT o_orderkey, list_element(['day', 'week', 'month', 'year'], 1 + (o_orderkey % 4)::INT) AS repeat, (SELECT min(d) FROM (SELECT unnest(generate_series(DATE '1997-02-28' + 1, DATE '1997-02-28' + 3300, INTERVAL 1 DAY))::DATE AS d)
  WHERE CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN (d - o_orderdate::DATE) % 7 = 0 WHEN 2 THEN day(d) = day(o_orderdate) ELSE day(d) = day(o_orderdate) AND month(d) = month(o_orderdate) END) AS due FROM orders""")
def d_next_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day after 28 February 1997 of orders that repeat by day, week, month or year."""
    repeat = F.element_at(F.array(*[F.lit(x) for x in ("day", "week", "month", "year")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("base"), repeat.alias("repeat"))
    return rows.select("o_orderkey", "repeat", dx.next_occurrence(F.col("base"), F.col("repeat"), F.to_date(F.lit("1997-02-28"))).alias("due"))


_CRON = {0: ("30 7 * * *", [0, 1, 2, 3, 4, 5, 6], 450), 1: ("0 18 * * 1-5", [1, 2, 3, 4, 5], 1080), 2: ("15 9 * * 1,3,7", [1, 3, 0], 555), 3: ("0 9 1 * *", None, 0), 4: ("5 0 * * 6", [6], 5), 5: ("x", None, 0)}
_CRON_SQL = " ".join(f"WHEN {k} THEN (SELECT min(t) FROM (SELECT date_trunc('day', ts) + INTERVAL 1 DAY * unnest(range(0, 8)) + INTERVAL {m} MINUTE AS t) WHERE t > ts AND dayofweek(t) IN ({', '.join(map(str, d))}))" for k, (_, d, m) in _CRON.items() if d)


@query(f"SELECT event_id, CASE event_id % 6 {_CRON_SQL} END AS due FROM events")
def d_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next run of small schedules; forms that can't be read have none."""
    cron = F.element_at(F.array(*[F.lit(c) for c, _, _ in _CRON.values()]), (F.col("event_id") % 6 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", dx.next_run(cron, ts).cast("timestamp_ntz").alias("due"))


@query("""
SELECT event_id, n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15') WHERE n <= 5""")
def d_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first five events in the seven days from a moment on."""
    at = F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00"))
    rows = table(spark, sf_dir, "events").where((F.col("ts") >= at) & (F.col("ts") < at + F.expr("INTERVAL 7 DAY")))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("event_id", n.alias("n")).where("n <= 5")


@query("SELECT event_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS age FROM events")
def d_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days since the event's day."""
    return table(spark, sf_dir, "events").select("event_id", F.datediff(F.to_date(F.lit("2024-02-01")), F.col("ts").cast("date")).cast("long").alias("age"))


@query("SELECT vec_id, array_to_string(list_transform(e, lambda x: greatest(-127, least(127, floor(x / (CASE WHEN m > 0 THEN m / 127 ELSE 1 END) + 0.5)))::INT), ',') AS codes FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS m FROM embeddings)")
def v_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's int8 codes."""
    codes = vx.quantise(F.col("embedding"), vx.quantise_scale(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"))


@query("""
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS step FROM embeddings)
SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN round(list_sum(e), 5) WHEN 1 THEN round(list_sum(list_transform(e, lambda x: floor(x / step + 0.5))) * step, 5) END AS total FROM s""")
def v_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes (floats, int8 codes, or cut off) and back; broken ones are null."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vx.quantise_scale(F.col("embedding")).alias("step"))
    codes = rows.withColumns({"floats": vx.as_blob(F.col("embedding"), "float"), "bytes": vx.as_blob(vx.quantise(F.col("embedding"), F.col("step")), "int8")})
    kind = F.col("vec_id") % 3
    blob = F.when(kind == 0, F.col("floats")).when(kind == 1, F.col("bytes")).otherwise(F.substring("floats", 1, 10))
    back = codes.select("vec_id", vx.from_blob(blob, 64, F.col("step")).alias("e"))
    return back.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""
WITH c AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (3, 14, 15))
SELECT vec_id, round(max(list_cosine_similarity(embedding::DOUBLE[], e)), 6) AS best FROM embeddings, c GROUP BY vec_id""")
def v_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest cosine with three given vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    given = vectors.where("vec_id IN (3, 14, 15)").select("embedding").collect()  # three rows
    others = F.array(*[F.array(*[F.lit(float(x)) for x in r.embedding]) for r in given])
    return vectors.select("vec_id", F.round(vx.most_similar(F.col("embedding"), others), 6).alias("best"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_transform(range(1, 65), lambda i: (i % 5 - 2) / 10.0::DOUBLE)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 0.05, 6) AS score FROM embeddings")
def v_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear score of the unit vector."""
    weights = F.array(*[F.lit((i % 5 - 2) / 10) for i in range(1, 65)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.linear_score(F.col("embedding"), weights, 0.05), 6).alias("score"))
