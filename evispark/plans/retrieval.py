"""Retrieval queries: lexical and vector search, gates, fusion and evaluation.

Questions are the benchmark's items; vector questions are the rows whose vec_id is divisible by 50. Scores are
rounded to six decimals before they are ranked, so that the order of additions never decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.functions import vectors as vx
from evispark.operators import ranking as rk
from evispark.operators import retrieve as rr
from evispark.operators import similarity as sm
from evispark.plans.registry import query, sql_tokens, table

_STOP = ", ".join(f"'{w}'" for w in sorted(rk.STOP_WORDS))
_FORMS = """list_concat([term], CASE WHEN length(term) < 4 OR term NOT LIKE '%s' OR regexp_matches(term, '(ss|is|us)$') THEN []
  WHEN term LIKE '%ies' THEN [left(term, length(term) - 3) || 'y']
  WHEN regexp_matches(term, '(s|x|z|o|ch|sh)es$') THEN [left(term, length(term) - 1), left(term, length(term) - 2)]
  ELSE [left(term, length(term) - 1)] END)"""
#: qt: the content words of each question, one after another, unless a form of it was taken before; qk: what to look for.
_TERMS = f"""
qw AS (SELECT q, term, row_number() OVER (PARTITION BY q ORDER BY pos) AS i, {_FORMS} AS forms FROM (
  SELECT q, term, min(pos) AS pos FROM (SELECT item_id AS q, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {sql_tokens("text")} AS t FROM benchmark))
  WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY q, term)),
qs AS (SELECT DISTINCT q, 0 AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS terms FROM qw
  UNION ALL SELECT s.q, s.i + 1, CASE WHEN len(s.terms) >= 12 OR list_has_any(s.seen, w.forms) THEN s.seen ELSE list_concat(s.seen, w.forms) END,
    CASE WHEN len(s.terms) >= 12 OR list_has_any(s.seen, w.forms) THEN s.terms ELSE list_append(s.terms, w.term) END FROM qs s JOIN qw w ON w.q = s.q AND w.i = s.i + 1),
qt AS (SELECT q, unnest(terms) AS term FROM (SELECT q, terms FROM qs QUALIFY row_number() OVER (PARTITION BY q ORDER BY i DESC) = 1)),
qk AS (SELECT q, term, '=' || unnest({_FORMS}) AS key FROM qt
  UNION ALL SELECT q, term, '^' || left(term, greatest(4, length(term) - 2)) FROM qt WHERE length(term) >= 5 AND NOT regexp_matches(term, '[0-9]'))"""
_HITS = """
v AS (SELECT DISTINCT term AS token FROM p),
vk AS (SELECT DISTINCT token, key FROM v JOIN (SELECT DISTINCT key FROM qk) k ON k.key = '=' || token
  UNION SELECT token, key FROM v, (SELECT DISTINCT key FROM qk WHERE key LIKE '^%') k WHERE starts_with(token, substr(key, 2)))"""


def _bm25_sql(of: str = "0") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id AS doc, {of} AS corpus, {sql_tokens("text")} AS t FROM documents),
s AS (SELECT corpus, count(*) AS n_docs, avg(len(t)) AS avg_len FROM d GROUP BY corpus),
p AS (SELECT corpus, doc, dl, term, count(*) AS tf FROM (SELECT corpus, doc, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY corpus, doc, dl, term),
{_TERMS}, {_HITS},
h AS (SELECT corpus, doc, dl, key, sum(tf) AS tf FROM p JOIN vk ON token = term GROUP BY corpus, doc, dl, key),
df AS (SELECT corpus, key, count(*) AS df FROM h GROUP BY corpus, key),
scored AS (SELECT q, corpus, doc, count(DISTINCT term) AS matched, count(DISTINCT CASE WHEN key LIKE '=%' THEN term END) AS exact,
    round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 6) AS score
  FROM h JOIN df USING (corpus, key) JOIN s USING (corpus) JOIN qk USING (key) GROUP BY q, corpus, doc),
n AS (SELECT q, count(*) AS n FROM qt GROUP BY q),
gated AS (SELECT scored.* FROM scored JOIN n USING (q) WHERE matched >= CASE WHEN n <= 2 THEN n ELSE ceil(n / 2.0) END)"""


_BM25 = _bm25_sql()
_VECTORS = """
WITH pairs AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""


def _top(rows: str, k: int, columns: str = "q, doc, score, rank") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM {rows}) WHERE rank <= {k}"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.content_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(q, doc, score, matched, exact) of every hit, and the questions' terms (q, term, key)."""
    terms = _terms(spark, sf_dir)
    found = rk.bm25_content(table(spark, sf_dir, "documents"), terms, "doc_id", "text")
    return found.withColumn("score", F.round("score", 6)), terms


def _gated(scored: DataFrame, terms: DataFrame) -> DataFrame:
    return rk.coverage_gate(scored, terms.select("q", "term").distinct())


@query(f"{_BM25} {_top('scored', 10)}")
def h_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words with their singulars and prefixes, BM25, best ten."""
    return rk.top_k(_scored(spark, sf_dir)[0], 10).select("q", "doc", "score", "rank")


@query(f"{_BM25} SELECT q, doc, matched, exact FROM gated")
def h_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(*_scored(spark, sf_dir)).select("q", "doc", "matched", "exact")


@query(f"{_BM25} {_top('gated', 10, 'q, doc, score, matched, rank')}")
def h_content_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search as a whole: content words, BM25, coverage gate, best ten."""
    return rk.top_k(_gated(*_scored(spark, sf_dir)), 10).select("q", "doc", "score", "matched", "rank")


@query(f"WITH RECURSIVE {_TERMS} SELECT q, term, key FROM qk")
def f_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query builder: what each question looks for."""
    return _terms(spark, sf_dir)


_HINT = "list_filter(t, lambda w: list_contains({words}, w))"


def _hint_sql(tokens: str) -> str:
    shares = {k: f"len(list_filter({tokens}, lambda w: list_contains({v.split()!r}, w))) / len({tokens})" for k, v in tx.LANGUAGE_HINTS.items()}
    return f"""(SELECT CASE WHEN n < 4 OR greatest(en, es, pt) < 0.08 OR greatest(en, es, pt) - list_sort([en, es, pt])[2] < 0.03 THEN NULL
      WHEN en = greatest(en, es, pt) THEN 'en' WHEN es = greatest(en, es, pt) THEN 'es' ELSE 'pt' END
    FROM (SELECT len({tokens}) AS n, {', '.join(f'{v} AS {k}' for k, v in shares.items())}))"""


@query(f"SELECT doc_id, {_hint_sql('t')} AS hint FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def f_language_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """en, es or pt by hint words, or null."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", tx.language_hint(F.col("t")).alias("hint"))


@query(f"""{_BM25}, ql AS (SELECT item_id AS q, {_hint_sql('t')} AS q_lang FROM (SELECT item_id, {sql_tokens('text')} AS t FROM benchmark)),
dl AS (SELECT doc, {_hint_sql('t')} AS doc_lang FROM d)
SELECT q, doc, score FROM gated JOIN n USING (q) JOIN ql USING (q) LEFT JOIN dl USING (doc) WHERE NOT coalesce(q_lang <> doc_lang, false) OR exact = n""")
def h_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage gate with its discipline of languages: a hit in another language needs all terms by exact forms."""
    scored, terms = _scored(spark, sf_dir)
    hint = lambda c: tx.language_hint(tx.tokens(F.col(c)))
    counted = terms.groupBy("q").agg(F.countDistinct("term").alias("n_terms"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), hint("text").alias("q_lang")).join(counted, "q")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), hint("text").alias("doc_lang"))
    return rk.language_gate(_gated(scored, terms), asked, docs).select("q", "doc", "score")


@query(f"""{_BM25}, pool AS ({_top('scored', 48)}), served AS (SELECT q, doc, score FROM pool JOIN gated USING (q, doc, score)),
m AS (SELECT DISTINCT q, doc, qk.term FROM pool JOIN qk USING (q) JOIN vk USING (key) JOIN p USING (doc) WHERE p.term = vk.token),
sizes AS (SELECT q, count(*) AS pool FROM pool GROUP BY q), dfs AS (SELECT q, term, count(doc) AS df FROM qt LEFT JOIN m USING (q, term) GROUP BY q, term),
weak AS (SELECT q FROM dfs JOIN sizes USING (q) GROUP BY q HAVING any_value(pool) >= 8 AND count(*) >= 3 AND min(df) = 0),
founded AS (SELECT DISTINCT m.q FROM m JOIN dfs USING (q, term) JOIN sizes USING (q) JOIN served USING (q, doc) WHERE df > 0 AND 2 * df <= pool)
SELECT q, doc, score FROM served WHERE q NOT IN (SELECT q FROM weak WHERE q NOT IN (SELECT q FROM founded))""")
def h_unfounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus-absence gate over the best 48 of each question."""
    scored, terms = _scored(spark, sf_dir)
    pool = rk.top_k(scored, 48)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text").join(pool.select("doc").distinct(), "doc")
    tokens = docs.select("doc", F.explode_outer(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    matches = rk.key_matches(tokens, terms.select("key").distinct()).distinct().join(terms, "key").join(pool.select("q", "doc"), ["q", "doc"]).select("q", "doc", "term").distinct()
    return rk.unfounded(pool, _gated(pool, terms), matches, terms).select("q", "doc", "score")


@query(f"""{_bm25_sql("coalesce(lang, '')")}, g AS (SELECT q, corpus, count(*) AS n, avg(score) AS m, stddev_pop(score) AS sd, max(score) AS hi FROM scored GROUP BY q, corpus),
normed AS (SELECT q, corpus, doc, round(CASE WHEN n < 3 OR sd <= 1e-6 THEN 0.5 * scored.score / greatest(hi, 1e-9) ELSE 1 / (1 + exp(-(scored.score - m) / sd)) END, 5) AS score FROM scored JOIN g USING (q, corpus))
{_top('normed', 10, 'q, corpus, doc, score, rank')}""")
def h_corpora_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several corpora (here one for each language) searched at once, each with its own statistics; scores normalised by corpus, then ranked together."""
    docs = table(spark, sf_dir, "documents")
    found = rk.bm25_content(docs, _terms(spark, sf_dir), "doc_id", "text", corpus=F.coalesce("lang", F.lit(""))).withColumn("score", F.round("score", 6))
    normed = rk.normalise(found, by=["q", "corpus"]).select("q", "corpus", "doc", F.round("norm", 5).alias("score"))
    return rk.top_k(normed, 10).select("q", "corpus", "doc", "score", "rank")


@query(f"""
WITH RECURSIVE {_TERMS}, parts AS (
  SELECT doc_id AS doc, 2 AS weight, unnest({sql_tokens("split_part(text, chr(10), 1)")}) AS token FROM documents
  UNION ALL SELECT doc_id, 1, unnest({sql_tokens("text")}) FROM documents),
scored AS (SELECT q, doc, sum(weight)::BIGINT AS score FROM parts JOIN qk ON key = '=' || token GROUP BY q, doc)
{_top('scored', 10)}""")
def h_field_tf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the terms' forms, twice in the title (a document's first line)."""
    docs = table(spark, sf_dir, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    return rk.top_k(rk.field_weighted_tf(docs, _terms(spark, sf_dir), "doc_id", "title", "text"), 10).select("q", "doc", "score", "rank")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return vectors, vectors.where("doc % 50 = 0").select(F.col("doc").alias("q"), F.col("embedding").alias("asked"))


@query(f"{_VECTORS} {_top('pairs', 10)}")
def h_semantic_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.similar(*_asked(spark, sf_dir), k=10)


_STORED = """
WITH steps AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS step FROM embeddings),
coded AS (SELECT vec_id, e, step, list_transform(e, lambda x: greatest(-127, least(127, floor(x / step + 0.5)))) AS codes FROM steps)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, blob, step): ids by 3: floats, int8 codes, floats; every id of remainder 3 by 7 is cut short."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding", vx.quantise_scale(F.col("embedding")).alias("step"))
    codes = vx.as_blob(vx.quantise(F.col("embedding"), F.col("step")), "int8")
    blob = F.when(F.col("doc") % 3 == 1, codes).otherwise(vx.as_blob(F.col("embedding"), "float"))
    return rows.select("doc", F.when(F.col("doc") % 7 == 3, F.substring(blob, 1, 50)).otherwise(blob).alias("blob"), "step")


@query(f"""{_STORED},
known AS (SELECT vec_id, CASE vec_id % 3 WHEN 1 THEN codes ELSE e END AS e FROM coded WHERE vec_id % 7 <> 3),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM known a, known b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
{_top('pairs', 10)}""")
def h_mixed_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic search over a table whose rows are floats or int8 codes; broken rows take no part, as question or as document."""
    stored = _stored(spark, sf_dir)
    return sm.similar_stored(stored, stored.where("doc % 50 = 0").select(F.col("doc").alias("q"), F.col("blob").alias("asked"), "step"), 64, k=10)


@query("""
SELECT CASE WHEN vec_id % 7 = 3 THEN 'broken' WHEN vec_id % 3 = 1 THEN 'int8' ELSE 'float' END AS kind, count(*) AS n,
  sum(CASE WHEN vec_id % 7 = 3 THEN 50 WHEN vec_id % 3 = 1 THEN 64 ELSE 256 END)::BIGINT AS bytes FROM embeddings GROUP BY 1""")
def v_stored_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.stored_kinds(_stored(spark, sf_dir), 64)


@query(f"""{_STORED}
SELECT vec_id AS doc, CASE WHEN vec_id % 7 = 3 THEN 50 ELSE 64 END AS size, CASE WHEN vec_id % 7 <> 3 THEN round(list_sum(codes) * step, 5) END AS total FROM coded""")
def v_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed table after its migration to int8, done twice: broken rows stay, and the second run changes nothing."""
    once = sm.migrated(sm.migrated(_stored(spark, sf_dir), 64), 64)
    numbers = vx.from_blob(F.col("blob"), 64, F.col("step"))
    total = F.when(F.octet_length("blob") == 64, F.round(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x), 5))
    return once.select("doc", F.octet_length("blob").alias("size"), total.alias("total"))


@query(f"""{_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY q) AS n FROM pairs),
b AS (SELECT q, avg(score) AS back FROM r WHERE rank BETWEEN 11 AND 50 GROUP BY q)
SELECT q, doc, score FROM r LEFT JOIN b USING (q) WHERE score >= CASE WHEN n > 50 THEN greatest(0.1, back + 0.05) ELSE 0.1 END""")
def h_distinct_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.distinct_floor(sm.similar(*_asked(spark, sf_dir), apart=rk.background(0.1, 0.05)), 0.1, 0.05)


@query(f"""{_VECTORS}, t AS ({_top('pairs', 50)}),
g AS (SELECT *, max(score) OVER (PARTITION BY q) AS hi, min(score) OVER (PARTITION BY q) AS lo FROM t)
SELECT q, doc, score FROM g WHERE score >= hi - 0.4 * (hi - lo)""")
def h_margin_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.margin_prune(sm.similar(*_asked(spark, sf_dir), k=50)).select("q", "doc", "score")


@query(f"""{_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank, count(*) OVER (PARTITION BY q) AS n FROM pairs),
b AS (SELECT q, CASE WHEN any_value(n) > 50 THEN greatest(0.1, avg(CASE WHEN rank BETWEEN 11 AND 50 THEN score END) + 0.05) ELSE 0.1 END AS bar FROM r GROUP BY q),
f AS (SELECT q, doc, score FROM r JOIN b USING (q) WHERE score >= bar AND score >= 0.12),
g AS (SELECT *, max(score) OVER (PARTITION BY q) AS hi, min(score) OVER (PARTITION BY q) AS lo FROM f),
served AS (SELECT q, doc, score FROM g WHERE score >= hi - 0.4 * (hi - lo))
SELECT q, doc, score, rank, n_chars FROM ({_top('served', 6)}) LEFT JOIN documents ON doc_id = doc""")
def h_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic search as a whole: cosine, background floor, absolute floor, margin, best six, then the survivors' text sizes."""
    found = rk.distinct_floor(sm.similar(*_asked(spark, sf_dir), apart=rk.background(0.1, 0.05)), 0.1, 0.05)
    served = rk.top_k(rk.margin_prune(rk.score_floor(found, 0.12)), 6)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    return served.join(sizes, "doc", "left").select("q", "doc", "score", "rank", "n_chars")


@query(f"""{_BM25}, g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd, max(score) OVER w AS hi FROM scored WINDOW w AS (PARTITION BY q))
SELECT q, doc, round(CASE WHEN n < 3 OR sd <= 1e-6 THEN 0.5 * score / greatest(hi, 1e-9) ELSE 1 / (1 + exp(-(score - m) / sd)) END, 5) AS norm FROM g""")
def h_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.normalise(_scored(spark, sf_dir)[0], by=["q"]).select("q", "doc", F.round("norm", 5).alias("norm"))


_FUSED = f"""{_BM25},
lex AS ({_top('gated', 50, 'q, doc, score')}),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) AND a.vec_id <> b.vec_id),
sem AS ({_top('pairs', 50, 'q, doc, score')}),
parts AS (SELECT q, doc, score / greatest(max(score) OVER (PARTITION BY q), 1e-9) * 0.5 AS part, 'lexical' AS side, NULL::DOUBLE AS raw FROM lex
  UNION ALL SELECT q, doc, score / greatest(max(score) OVER (PARTITION BY q), 1e-9) * 0.5, 'semantic', score FROM sem),
fused AS (SELECT f.*, coalesce(nullif(lower(trim(split_part(text, chr(10), 1), ' ')), ''), '#' || doc) AS article, coalesce(source = 'src1', false) AS own FROM (
  SELECT q, doc, round(sum(part), 6) AS score, CASE WHEN count(DISTINCT side) = 2 THEN 'hybrid' ELSE max(side) END AS match, max(raw) AS raw FROM parts GROUP BY q, doc) f LEFT JOIN documents ON doc_id = doc),
capped AS (SELECT *, row_number() OVER (PARTITION BY q, article ORDER BY score DESC, doc) AS g FROM fused)"""


@query(f"{_FUSED} {_top('(SELECT * FROM capped WHERE g <= 2)', 10, 'q, doc, score, match, raw, rank')}")
def h_hybrid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated BM25 and cosine, each side's best 50 over its greatest, fused, at most two documents of a title, best ten.

    An item's vector is that of the same number; a document's too.
    """
    capped = rk.cap_groups(_fused(spark, sf_dir)[0], F.col("article"))
    return rk.top_k(capped, 10).select("q", "doc", "score", "match", "raw", "rank")


@query(f"""{_FUSED}, kept AS ({_top('(SELECT * FROM capped WHERE g <= 2)', 10, '*')}),
state AS (SELECT q, bool_or(own) AS has, count(*) AS n, min(score) AS last FROM kept GROUP BY q),
best AS ({_top('(SELECT * FROM fused WHERE own)', 1, 'q, doc, score, match, raw, article, own')}),
entering AS (SELECT best.*, least(n + 1, 10) AS rank FROM best JOIN state USING (q)
  WHERE NOT has AND (SELECT count(*) FROM kept k WHERE k.q = best.q AND k.article = best.article) < 2 AND (n < 10 OR last <= score * 1.25)),
reserved AS (SELECT q, doc, score, raw, own, rank FROM kept WHERE (q, rank) NOT IN (SELECT q, rank FROM entering) UNION ALL SELECT q, doc, score, raw, own, rank FROM entering)
SELECT r.q, r.doc, r.score, r.own, r.rank FROM reserved r LEFT JOIN scored s USING (q, doc) LEFT JOIN n USING (q)
WHERE CASE WHEN raw IS NOT NULL THEN raw >= 0.2 ELSE matched IS NULL OR matched / n > 0.5 OR own END""")
def h_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fusion: caps by article, a place kept for the user's own documents (here: source src1), and the absolute gate at last."""
    fused, lexical, terms = _fused(spark, sf_dir)
    kept = rk.reserve(fused, 10, F.col("article"), F.col("own"))
    n = terms.groupBy("q").agg(F.countDistinct("term").alias("n"))
    # the gate asks for the coverage of rows without a semantic score, which all come from the lexical side's best
    coverage = lexical.join(n, "q").select("q", "doc", (F.col("matched") / F.col("n")).alias("share"))
    return rk.absolute_gate(kept, coverage, 0.2, F.col("own")).select("q", "doc", "score", "own", "rank")


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fused rows with their article and owner, the lexical side's best (q, doc, score, matched), and the questions' terms."""
    scored, terms = _scored(spark, sf_dir)
    lexical = rk.top_k(_gated(scored, terms), 50).select("q", "doc", "score", "matched")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q")).distinct()
    asked = vectors.join(items, F.col("doc") == F.col("q")).select("q", F.col("embedding").alias("asked"))
    fused = rk.fuse(lexical, sm.similar(vectors, asked, k=50)).withColumn("score", F.round("score", 6))
    title = F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), title.alias("title"), F.coalesce(F.col("source") == "src1", F.lit(False)).alias("own"))
    named = fused.join(docs, "doc", "left").withColumns({"article": F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("#"), "doc")), "own": F.coalesce("own", F.lit(False))})
    return named.drop("title"), lexical, terms


_EVAL = """
WITH ranked AS (SELECT o_custkey AS q, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
e AS (SELECT o_custkey AS q, min(rank) AS best, count(*) AS n FROM orders JOIN ranked ON o_custkey = q AND o_orderkey = doc WHERE o_orderstatus = 'F' GROUP BY o_custkey),
rows AS (SELECT q, best <= 1 AS hit1, best <= 3 AS hit3, best <= 6 AS hit6, 1.0 / best AS rr FROM e)"""


@query(f"{_EVAL} SELECT q, hit1, hit3, hit6, round(rr, 6) AS rr FROM rows")
def h_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking a customer's orders by price, judged by those with status F."""
    return _judged(spark, sf_dir).select("q", "hit1", "hit3", "hit6", F.round("rr", 6).alias("rr"))


@query(f"{_EVAL} SELECT count(*) AS n, round(avg(hit1::INT), 6) AS hit1, round(avg(hit3::INT), 6) AS hit3, round(avg(hit6::INT), 6) AS hit6, round(avg(rr), 6) AS mrr FROM rows")
def h_evaluate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c)
    return _judged(spark, sf_dir).agg(F.count("*").alias("n"), rate("hit1"), rate("hit3"), rate("hit6"), F.round(F.avg("rr"), 6).alias("mrr"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return rk.evaluate(orders.withColumn("rank", rank), orders.where("o_orderstatus = 'F'").select("q", "doc"))


@query("""
WITH g AS (SELECT unnest(generate_series(0, 40)) * 500 AS bar),
d AS (SELECT n_chars, toxic FROM documents JOIN labels USING (doc_id)),
c AS (SELECT n_chars, sum((toxic = 1)::INT) AS hits, sum((toxic = 0)::INT) AS false_hits FROM d GROUP BY n_chars),
t AS (SELECT sum(hits) AS all_hits, sum(false_hits) AS all_false FROM c)
SELECT bar::BIGINT AS bar, round(coalesce(sum(hits), 0) / any_value(all_hits), 6) AS recall, round(coalesce(sum(false_hits), 0) / any_value(all_false), 6) AS false_rate
FROM g CROSS JOIN t LEFT JOIN c ON c.n_chars >= bar GROUP BY bar""")
def h_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and false accepts of 'at least bar characters' as a test for toxic, over a grid of bars.

    The rows are counted into the grid's steps first; the sweep itself adds up 41 counts from above.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    step = F.least(F.floor(F.col("n_chars") / 500) * 500, F.lit(20_000)).cast("long")
    counted = rows.groupBy(step.alias("bar")).agg(F.count_if(F.col("toxic") == 1).alias("hits"), F.count_if(F.col("toxic") == 0).alias("false_hits"))
    grid = spark.range(0, 20_001, 500).select(F.col("id").alias("bar")).join(F.broadcast(counted), "bar", "left").fillna(0)
    above, whole = Window.orderBy(F.desc("bar")), Window.partitionBy()
    share = lambda c: F.round(F.sum(c).over(above) / F.sum(c).over(whole), 6)
    return grid.select("bar", share("hits").alias("recall"), share("false_hits").alias("false_rate"))


def _of_corpus(rows: str, k: int) -> str:
    return f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY q, corpus ORDER BY score DESC, doc) AS place FROM {rows}) WHERE place <= {k}"


@query(f"""{_bm25_sql("coalesce(lang, '')")},
pool AS ({_of_corpus('scored', 48)}), lex AS ({_of_corpus('gated', 50)}),
pairs AS (SELECT a.vec_id AS q, coalesce(lang, '') AS corpus, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN documents ON doc_id = b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
sem AS ({_of_corpus('(SELECT * FROM pairs WHERE score >= 0.1)', 50)}),
parts AS (SELECT q, corpus, doc, score / greatest(max(score) OVER (PARTITION BY q, corpus), 1e-9) * 0.5 AS part, 'lexical' AS side FROM lex
  UNION ALL SELECT q, corpus, doc, score / greatest(max(score) OVER (PARTITION BY q, corpus), 1e-9) * 0.5, 'semantic' FROM sem),
fused AS (SELECT f.*, coalesce(nullif(lower(trim(split_part(text, chr(10), 1), ' ')), ''), '#' || doc) AS article FROM (
  SELECT q, corpus, doc, round(sum(part), 6) AS score, CASE WHEN count(DISTINCT side) = 2 THEN 'hybrid' ELSE max(side) END AS match FROM parts GROUP BY q, corpus, doc) f JOIN documents ON doc_id = doc),
capped AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY q, corpus, article ORDER BY score DESC, doc) <= 2),
served AS ({_of_corpus('capped', 10)}),
m AS (SELECT DISTINCT q, corpus, doc, qk.term FROM pool JOIN qk USING (q) JOIN vk USING (key) JOIN p USING (corpus, doc) WHERE p.term = vk.token),
sizes AS (SELECT q, corpus, count(*) AS pool FROM pool GROUP BY q, corpus),
dfs AS (SELECT s.q, s.corpus, t.term, count(doc) AS df FROM sizes s JOIN qt t USING (q) LEFT JOIN m ON m.q = s.q AND m.corpus = s.corpus AND m.term = t.term GROUP BY ALL),
weak AS (SELECT q, corpus FROM dfs JOIN sizes USING (q, corpus) GROUP BY q, corpus HAVING any_value(pool) >= 8 AND count(*) >= 3 AND min(df) = 0),
founded AS (SELECT DISTINCT m.q, m.corpus FROM m JOIN dfs USING (q, corpus, term) JOIN sizes USING (q, corpus) JOIN served USING (q, corpus, doc) WHERE df > 0 AND 2 * df <= pool),
kept AS (SELECT * FROM served WHERE (q, corpus) NOT IN (SELECT (q, corpus) FROM weak WHERE (q, corpus) NOT IN (SELECT (q, corpus) FROM founded))),
g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd, max(score) OVER w AS hi FROM kept WINDOW w AS (PARTITION BY q, corpus)),
normed AS (SELECT q, corpus, doc, match, round(CASE WHEN n < 3 OR sd <= 1e-6 THEN 0.5 * score / greatest(hi, 1e-9) ELSE 1 / (1 + exp(-(score - mean) / sd)) END, 5) AS score FROM g)
{_top('normed', 10, 'q, corpus, doc, score, match, rank')}""")
def h_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval as a whole: each language is a corpus with its own gates, caps and absence rule; the best ten of all."""
    docs, items, vectors = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "embeddings"))
    title = F.nullif(F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))), F.lit(""))
    place = docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("corpus"), "text", title.alias("article"))
    questions = items.select(F.col("item_id").alias("q"), "text")
    own = vectors.select(F.col("vec_id").alias("doc"), "embedding")
    asked = own.join(questions.select("q").distinct(), F.col("doc") == F.col("q")).select("q", F.col("embedding").alias("asked"))
    return rr.retrieve(place, own, questions, asked)
