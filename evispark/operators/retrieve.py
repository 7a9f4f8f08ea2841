"""Retrieval as a whole over several corpora: every gate, cap and statistic holds within a corpus; the corpora meet at the end.

A question and a corpus make one key of the ranking rules (``ranking``), so a batch of questions against any number of
corpora is one plan. In each corpus: BM25 over content words, their forms and starts, gated by coverage; cosine over a floor;
both sides fused; at most two documents of an article; nothing at all if the corpus doesn't hold the question's subject.
Then each corpus's scores are normalised by themselves, and the best of all corpora are served.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators import ranking as rk
from evispark.operators import similarity as sm


@dataclass(frozen=True)
class Rules:
    """Rows of each side, of the pool that the absence rule looks at, of a corpus, of an answer; least cosine; rows of an article."""

    side: int = 50
    pool: int = 48
    corpus: int = 10
    served: int = 10
    floor: float = 0.1
    article: int = 2


def retrieve(docs: DataFrame, vectors: DataFrame, questions: DataFrame, asked: DataFrame, *, rules: Rules = Rules()) -> DataFrame:
    """(q, corpus, doc, score, match, rank) of the best documents of each question.

    docs: (doc, corpus, text, article), vectors: (doc, embedding), questions: (q, text), asked: (q, asked) with the vectors of those
    questions that have one. Scores are rounded to six decimals before they are ranked, normalised ones to five; ties go to the smaller doc.
    """
    key = F.struct("q", "corpus")
    place = docs.select("doc", F.coalesce("corpus", F.lit("")).alias("corpus"), "text", "article")
    words = rk.content_terms(questions, "q", "text")
    found = rk.bm25_content(place, words, "doc", "text", corpus=F.col("corpus")).withColumn("score", F.round("score", 6))
    scored = found.select(key.alias("q"), "doc", "score", "matched")
    gated = rk.coverage_gate(found, words.select("q", "term").distinct()).select(key.alias("q"), "doc", "score")
    lexical = rk.top_k(gated, rules.side).select("q", "doc", "score")

    near = sm.similar(vectors, asked, least=rules.floor).join(place.select("doc", "corpus"), "doc")
    semantic = rk.top_k(near.select(key.alias("q"), "doc", "score"), rules.side).select("q", "doc", "score")
    fused = rk.fuse(lexical, semantic).withColumn("score", F.round("score", 6)).join(place.select("doc", "article"), "doc")
    served = rk.top_k(rk.cap_groups(fused, F.coalesce("article", F.concat(F.lit("#"), F.col("doc"))), rules.article), rules.corpus).drop("rank", "article")

    pool = rk.top_k(scored, rules.pool)
    texts = place.join(pool.select("doc").distinct(), "doc")
    tokens = texts.select("doc", F.explode_outer(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    held = rk.key_matches(tokens, words.select("key").distinct()).distinct().join(words.select(F.col("q").alias("asker"), "term", "key"), "key")
    matches = held.join(pool.select("q", "doc"), "doc").where("q.q = asker").select("q", "doc", "term").distinct()
    terms = pool.select(F.col("q").alias("of")).distinct().join(words.select("q", "term").distinct(), F.col("of.q") == F.col("q"))
    kept = rk.unfounded(pool, served, matches, terms.select(F.col("of").alias("q"), "term"))

    normed = rk.normalise(kept, by=["q"]).select("q.q", "q.corpus", "doc", F.round("norm", 5).alias("score"), "match")
    return rk.top_k(normed, rules.served)
