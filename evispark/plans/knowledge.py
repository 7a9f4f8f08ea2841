"""Queries of facts, acronyms, guides and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import acronyms as ac
from evispark.operators import context as cx
from evispark.operators import facts as fc
from evispark.operators import guides as gd
from evispark.operators import similarity as sm
from evispark.plans.registry import query, table

_ACC, _PLAIN = tx.ACCENTED, tx.PLAIN


def _sql_words(c: str) -> str:
    folded = f"replace(translate(replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), 'ñ', chr(57345)), '{_ACC}', '{_PLAIN}'), chr(57345), 'ñ')"
    return f"trim(regexp_replace({folded}, '\\s+', ' ', 'g'), ' ')"


#: What events say: of each kind but every eleventh; views and errors have one value at a time.
_SAID = f"""
said AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 11 <> 0 THEN event_type END AS attribute, event_type IN ('view', 'error') AS single,
    'd' || floor(value / 9)::BIGINT || CASE WHEN event_id % 4 = 0 THEN ' Ñandú' ELSE '' END AS value,
    'My ' || event_type || CASE event_id % 3 WHEN 0 THEN ' is: ' WHEN 1 THEN ' now is ' ELSE ' was always, I say, ' END AS head FROM events),
e AS (SELECT user_id, event_id, attribute, single, head || value AS content, {_sql_words("head || value")} AS words, {_sql_words("value")} AS val,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM said)"""
_NEAR = "e.words <> '' AND f.words <> '' AND (contains(f.words, e.words) OR contains(e.words, f.words) OR len(list_intersect(string_split(e.words, ' '), string_split(f.words, ' '))) >= 0.75 * len(list_distinct(string_split(e.words || ' ' || f.words, ' '))))"
_FITS = "(list_has_all(string_split(e.val, ' '), string_split(f.val, ' ')) OR list_has_all(string_split(f.val, ' '), string_split(e.val, ' ')))"
_LOG = f"""
WITH RECURSIVE {_SAID},
fold AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, '' AS outcome, []::STRUCT(fact BIGINT, content VARCHAR, words VARCHAR, attribute VARCHAR, val VARCHAR)[] AS known FROM e
  UNION ALL
  SELECT user_id, i, event_id, outcome,
    list_prepend(CASE WHEN outcome = 'merged' AND contains(hit.words, words) THEN hit
      ELSE {{'fact': coalesce(hit.fact, event_id), 'content': content, 'words': words, 'attribute': attribute, 'val': val}} END, list_filter(known, lambda f: hit IS NULL OR f.fact <> hit.fact))
  FROM (
    SELECT *, CASE WHEN near IS NOT NULL OR fit IS NOT NULL THEN 'merged' WHEN same IS NOT NULL THEN 'replaced' ELSE 'added' END AS outcome, coalesce(near, fit, same) AS hit
    FROM (SELECT e.*, s.known, list_filter(s.known, lambda f: {_NEAR})[1] AS near,
        list_filter(s.known, lambda f: f.attribute = e.attribute AND (NOT e.single OR {_FITS}))[1] AS fit, list_filter(s.known, lambda f: f.attribute = e.attribute)[1] AS same
      FROM fold s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("event_id")
    value = F.concat(F.lit("d"), F.floor(F.col("value") / 9).cast("string"), F.when(k % 4 == 0, " Ñandú").otherwise(""))
    head = F.concat(F.lit("My "), kind, F.when(k % 3 == 0, " is: ").when(k % 3 == 1, " now is ").otherwise(" was always, I say, "))
    said = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(k % 11 != 0, kind).alias("attribute"), kind.isin("view", "error").alias("single"), value.alias("value"), head.alias("head"))
    return said.withColumn("content", F.concat("head", "value"))


def _log(said: DataFrame) -> DataFrame:
    return fc.absorb(said, "user_id", "ts", "event_id", "content", attribute="attribute", value="value", single="single")


@query(f"{_LOG} SELECT user_id, event_id, outcome, known[1].fact AS fact, known[1].content AS content FROM fold WHERE i > 0")
def s_fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each thing that a user said: added, merged, or in the place of another."""
    return _log(_said(spark, sf_dir)).select("user_id", "event_id", "outcome", "fact", "content")


@query(f"""{_LOG}
SELECT user_id, fact, arg_max(content, i) AS content, count(*) - 1 AS changes FROM (SELECT user_id, i, known[1].fact AS fact, known[1].content AS content FROM fold WHERE i > 0) GROUP BY ALL""")
def t_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's facts in the end, and how often they were changed."""
    said = _said(spark, sf_dir)
    return fc.facts_after(_log(said), said, "user_id", "ts", "event_id")


_FOLDED = lambda c: f"translate(lower({c}), '{_ACC}', '{_PLAIN}')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
#: Every document declares its first words: their initials in brackets after them, and before them.
_DECLARED = """
declared AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-zé ]', ' ', 'g'), ' '), lambda w: w <> '')[1:4] AS w, text FROM documents),
texts AS (SELECT doc_id, text || chr(10) || 'See the ' || array_to_string(w, ' ') || ' (' || upper(array_to_string(list_transform(w, lambda x: x[1:1]), '')) || '). <!-- no (AB) one --> '
  || upper(w[1][1:2]) || '-' || doc_id % 7 || ' (' || lower(w[2]) || ', ' || w[3] || ') and VII (seven of them), ' || w[1] || ' (IV) (see DEA)' AS text FROM declared)"""
_PAIRS = f"""
bodies AS (SELECT doc_id, regexp_replace(text, '<!--(.|\\n)*?-->', ' ', 'g') AS body FROM texts),
raw AS (
  SELECT doc_id, unnest(regexp_extract_all(body, '{ac.BEFORE}', 2)) AS acronym, unnest(regexp_extract_all(body, '{ac.BEFORE}', 1)) AS words, true AS named FROM bodies UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(body, '{ac.AFTER}', 1)), unnest(regexp_extract_all(body, '{ac.AFTER}', 2)), false FROM bodies),
cut AS (SELECT doc_id, acronym, named, string_split(trim(regexp_replace(words, '\\s+', ' ', 'g'), ' '), ' ') AS w FROM raw),
led AS (SELECT *, list_position(list_transform(w, lambda x: list_contains({_LIST([*ac.OPENERS, *ac.ARTICLES])}, {_FOLDED("x")})), false) AS lead FROM cut),
pairs AS (SELECT doc_id, acronym, array_to_string(CASE WHEN named THEN w[CASE WHEN coalesce(lead, 0) = 0 THEN len(w) ELSE lead END:] ELSE w END, ' ') AS definition FROM led WHERE named OR len(w) >= 2),
sound AS (SELECT *, {_FOLDED("definition")} AS folded FROM pairs
  WHERE length(definition) BETWEEN 3 AND 70 AND regexp_matches(definition, '{ac.SOUND}') AND NOT regexp_matches(definition, '^(?i)({ac.REFERENCES})\\b')
    AND (contains(definition, ' ') OR length(definition) >= 4) AND NOT list_contains({_LIST(ac.ROMAN)}, acronym))"""
_SHORT = _LIST([*ac.ARTICLES, "de", "del", "of", "y", "e", "and", "para", "for", "in", "en", "da", "do"])


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no more of a text than its first four words is cut up
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"\A(?:[^A-Za-zé]*+[A-Za-zé]++){0,4}+", 0)
    words = F.filter(F.split(head, "[^A-Za-zé]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    initials = F.upper(F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), ""))
    after = F.concat(F.upper(F.substring(w(0), 1, 2)), F.lit("-"), (F.col("doc_id") % 7).cast("string"), F.lit(" ("), F.lower(w(1)), F.lit(", "), w(2), F.lit(")"))
    made = F.concat("text", F.lit("\nSee the "), F.array_join("w", " "), F.lit(" ("), initials, F.lit("). <!-- no (AB) one --> "), after, F.lit(" and VII (seven of them), "), w(0), F.lit(" (IV) (see DEA)"))
    return rows.select("doc_id", made.alias("text"))


@query(f"WITH {_DECLARED}, {_PAIRS} SELECT doc_id, acronym, min(definition) AS definition FROM (SELECT doc_id, acronym, folded, definition FROM sound) GROUP BY doc_id, acronym, folded")
def f_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document says its acronyms stand for."""
    each = _declared(spark, sf_dir).select("doc_id", F.explode(ac.acronym_pairs(F.col("text"))).alias("p"))
    return each.select("doc_id", "p.acronym", "p.definition")


@query(f"""
WITH {_DECLARED}, {_PAIRS},
counted AS (SELECT acronym, folded, count(DISTINCT doc_id) AS n_texts, min(doc_id) AS example, arg_min(definition, (doc_id, definition)) AS definition FROM sound GROUP BY 1, 2),
split AS (SELECT *, list_filter(regexp_split_to_array(folded, '[ ,-]+'), lambda w: w <> '') AS ws, regexp_replace({_FOLDED("acronym")}, '[^a-z]', '', 'g') AS wanted FROM counted),
marked AS (SELECT *, array_to_string(list_transform(ws, lambda w: w[1:1]), '') = wanted
  OR array_to_string(list_transform(list_filter(ws, lambda w: NOT list_contains({_SHORT}, w)), lambda w: w[1:1]), '') = wanted AS spelled FROM split)
SELECT acronym, definition, n_texts, example, spelled, row_number() OVER (PARTITION BY acronym ORDER BY n_texts DESC, spelled DESC, folded) AS rank FROM marked""")
def a_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of the corpus with their definitions, the most declared first."""
    return ac.mined_acronyms(_declared(spark, sf_dir), "doc_id", "text")


_FITTED = """
WITH pairs AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT q, doc, rank, text AS body, 150 + q % 7 * 300 AS budget FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM pairs) JOIN documents ON doc_id = doc WHERE rank <= 10),
sized AS (SELECT *, 8 + ceil(length(body) / 3)::BIGINT AS whole, left(body, (budget - 8) * 3 + 1) AS room FROM ranked),
ends AS (SELECT *, regexp_extract(room, '(?s)\\A(.*[.!?…]["»”'')\\]]*)\\s', 1) AS sentence, regexp_replace(regexp_extract(room, '(?s)\\A(.*)\\n', 1), '\\s+$', '') AS line FROM sized),
cut AS (SELECT *, whole <= budget AS fits, CASE WHEN length(line) > length(sentence) THEN line ELSE sentence END AS short FROM ends),
judged AS (SELECT *, NOT fits AND short <> '' AND (length(short) >= 320 OR length(short) >= 0.25 * length(body)) AS useful FROM cut),
begun AS (SELECT * FROM (SELECT *, min(CASE WHEN fits OR useful THEN rank END) OVER (PARTITION BY q) AS start FROM judged) WHERE rank >= start),
kept AS (SELECT *, max(CASE WHEN rank = start THEN useful END) OVER (PARTITION BY q) AS truncated, sum(whole) OVER (PARTITION BY q ORDER BY rank) AS running FROM begun)
SELECT q, doc, rank, CASE WHEN truncated THEN short ELSE body END AS body, budget, 8 + ceil(length(CASE WHEN truncated THEN short ELSE body END) / 3)::BIGINT AS tokens, truncated
FROM kept WHERE CASE WHEN truncated THEN rank = start ELSE running <= budget END"""


@query(_FITTED)
def h_fitted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's ten nearest documents as far as they fit into its budget, which is 150 to 1,950 tokens."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    asked = vectors.where("doc % 50 = 0").select(F.col("doc").alias("q"), F.col("embedding").alias("asked"))
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    ranked = sm.similar(vectors, asked, k=10).join(bodies, "doc").select("q", "doc", "rank", "body", (150 + F.col("q") % 7 * 300).alias("budget"))
    return cx.fit_context(ranked, F.col("budget"))


@query()
def f_guide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that are written as guides: sentences as list items, some of them headings (no SQL; a plain version in the tests)."""
    docs = table(spark, sf_dir, "documents")
    mark = lambda i: F.when(i % 23 == 9, "# ").when(i % 7 == 2, "## ").when(i % 11 == 4, "### ").when(i % 13 == 5, "<!-- questions: what | ").otherwise("- ")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s"), lambda s, i: F.concat(mark(i), s, F.when(i % 13 == 5, " -->").otherwise("")))
    lang = F.when(F.col("lang").isin("es", "en", "pt"), F.col("lang")).otherwise("en")
    head = F.concat(F.lit("---\ntitle: Guide "), F.col("doc_id"), F.lit("\nlang: "), lang, F.lit("\nsources: here"), F.when(F.col("doc_id") % 50 == 7, "\nregion: xx").otherwise(""), F.lit("\n---\n"))
    found = gd.guide_chunks(docs.select("doc_id", F.concat(head, F.array_join(lines, "\n")).alias("text")), "doc_id", "text")
    return found.select("id", "title", "lang", "problem", "pos", F.array_join("path", " / ").alias("path"), "body", F.array_join("questions", "|").alias("questions"))
