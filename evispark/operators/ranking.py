"""Retrieval as joins, aggregates and windows: lexical scores, gates, normalisation, fusion, caps, evaluation.

Ranked frames carry a query key (``q``), a candidate key and a ``score``; every rule works for all queries at
once, partitioned by the query, so a batch of any number of questions is one plan. The query side is broadcast only
when its counted bytes are within a bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions import text as tx
from evispark.operators.sizes import BROADCAST_BYTES, bound_batches, small, stored_bytes
from evispark.operators.tables import spare

#: Fixed values of the BM25 ranking function.
K1, B = 1.2, 0.75
#: English, Spanish and Portuguese words (without accents) that say nothing of a question's subject.
STOP_WORDS = frozenset(
    (
        "a about after al algo alguem alguien all also am an and ante any anyone ao aos aquel are as at aunque bajo be because been before being best better between both but by cada can cause caused "
        "causes com como compare comparison con contra could cual cuales cuando da das de debe deberia debo del describe desde detail details deve devo did difference differences do does doing donde "
        "dos durante during e each el em en entre es esa esas ese esos esta estar estas esto estos explain faca faco faz fazer for from fue fueron give hace hacemos hacer haces hacia had haga hagan "
        "hago happen happened happens has hasta have having hay he her here him his how i if in into is it its just know la las le les like lo los mais me mean means meant mediante menos mi mis misma "
        "mismo more most much muito muy my na nas no nos not nuestra nuestro nunca o of on onde or os other otra otras otro otros our overview para pero please pode por porque posso puede puedo pues "
        "quais qual quando que quien same se sem ser she should show si siempre sin sino so sobre some somebody someone something son su such summarize summary sus tampoco tan tanto te tell than that "
        "the their them then there these they thing things this those through tiene tienen to toda todas todo todos too tras tu tus um uma umas un una unas under unos uns up us versus very vs want "
        "was we were what when where which while who whom whose why will with work works would y ya you your"
    ).split()
)


def query_terms(queries: DataFrame, q_col: str, text_col: str, most: int = 12) -> DataFrame:
    """(q, term): the first ``most`` distinct tokens of at least two characters of each query."""
    tokens = F.slice(F.array_distinct(F.filter(tx.tokens(F.col(text_col)), lambda t: F.length(t) >= 2)), 1, most)
    return queries.select(F.col(q_col).alias("q"), F.explode(tokens).alias("term"))


def content_terms(queries: DataFrame, q_col: str, text_col: str, most: int = 12) -> DataFrame:
    """(q, term, key): what to look for, for the first ``most`` content words of each query.

    Stop words and single characters are no content, nor is a word of which a form (itself, its singulars) was
    seen before. A term has a key "=form" for each form, and "^start" if it is long enough for a prefix.
    """
    forms = lambda t: F.concat(F.array(t), tx.singular_forms(t))
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    words = F.filter(tx.tokens(F.col(text_col)), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    none = F.array().cast("array<string>")

    def step(state: Column, t: Column) -> Column:
        known = (F.size(state["terms"]) >= most) | F.arrays_overlap(state["seen"], forms(t))
        return F.when(known, state).otherwise(F.struct(F.array_union(state["seen"], forms(t)).alias("seen"), F.array_append(state["terms"], t).alias("terms")))

    chosen = F.aggregate(F.array_distinct(words), F.struct(none.alias("seen"), none.alias("terms")), step)["terms"]
    terms = queries.select(F.col(q_col).alias("q"), F.explode(chosen).alias("term"))
    start = tx.prefix_form(F.col("term"))
    keys = F.concat(F.transform(forms(F.col("term")), lambda f: F.concat(F.lit("="), f)), F.when(start.isNotNull(), F.array(F.concat(F.lit("^"), start))).otherwise(none))
    return terms.select("q", "term", F.explode(keys).alias("key"))


def exact_keys(terms: DataFrame) -> DataFrame:
    """(q, term, key) of plain (q, term): each term matches itself alone."""
    return terms.select("q", "term", F.concat(F.lit("="), F.col("term")).alias("key"))


def key_matches(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (with a column ``token``) that a key ("=word" or "^start") fits, with the key.

    An equi-join on the first four characters, on which both kinds of key agree (starts have four at least); tokens
    that nobody asks for are dropped there, before any shuffle.
    """
    head = lambda c: F.substring(c, 1, 4)
    wanted = keys.select("key", F.expr("substring(key, 2)").alias("__word"), F.col("key").startswith("^").alias("__open"))
    joined = tokens.withColumn("__head", head("token")).join(small(wanted.withColumn("__head", head("__word"))), "__head")
    fits = F.when(F.col("__open"), F.startswith("token", "__word")).otherwise(F.col("token") == F.col("__word"))
    return joined.where(fits).drop("__head", "__word", "__open", "token")


def each_token(docs: DataFrame, text_col: str) -> DataFrame:
    """The other columns of ``docs`` with each ``token`` of the text (null of a text without one, which no key fits) and the text's ``doc_len`` in tokens."""
    kept = [c for c in docs.columns if c != text_col]
    # the length stands in a row before its tokens do: else each token would carry the whole array; an outer explode cuts up
    # a text once, where Spark gives a plain one a filter on the array's size that cuts it up before
    sized = docs.select(*kept, tx.tokens(F.col(text_col)).alias("__t")).select(*kept, F.size("__t").alias("doc_len"), "__t")
    return sized.select(*kept, "doc_len", F.explode_outer("__t").alias("token"))


def counted_keys(texts: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """The other columns of ``texts`` with the text's ``doc_len`` in tokens and its ``hits``: for each of the keys (``words``) that
    fits some of its tokens, the key's place in the list, times 2^32, plus the number of those tokens.

    A text's tokens are counted where they are cut up, so that neither they nor the matches of the same key are dealt out one
    by one. The keys are broadcast: give no more than fit.
    """
    spark = bound_batches(texts.sparkSession)
    kept = [c for c in texts.columns if c != text_col]
    shared = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, starts = {}, defaultdict(list)
        for i, key in enumerate(shared.value):
            if key.startswith("^"):
                starts[key[1:5]].append((key[1:], i))
            else:
                whole[key[1:]] = i
        for batch in batches:
            listed = pc.split_pattern(batch.column("__t"), " ")
            sizes = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, rows = listed.flatten().dictionary_encode(), np.repeat(np.arange(len(sizes)), sizes)
            sizes[pc.equal(batch.column("__t"), "").to_numpy(zero_copy_only=False)] = 0  # a text without tokens is split into one empty one, which no key fits
            fits = [([whole[w]] if w in whole else []) + [i for start, i in starts.get(w[:4], ()) if w.startswith(start)] if w else [] for w in flat.dictionary.to_pylist()]
            n = np.array([len(f) for f in fits], np.int64)
            ids = np.array([i for f in fits for i in f], np.int64)
            codes = flat.indices.to_numpy(zero_copy_only=False)
            if len(n):
                asked = n[codes] > 0
                codes, rows = codes[asked], rows[asked]
            each = n[codes]
            # a token's keys stand one after another in ids
            place = np.arange(each.sum()) + np.repeat((np.cumsum(n) - n)[codes] - (np.cumsum(each) - each), each)
            found, tf = np.unique(np.repeat(rows, each) << 32 | ids[place], return_counts=True)
            ends = np.searchsorted(found >> 32, np.arange(len(sizes) + 1)).astype(np.int32)
            hits = pa.ListArray.from_arrays(ends, pa.array((found & 0xFFFFFFFF) << 32 | tf))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sizes, pa.int32()), hits], [*kept, "doc_len", "hits"])

    schema = T.StructType([*[texts.schema[c] for c in kept], T.StructField("doc_len", T.IntegerType()), T.StructField("hits", T.ArrayType(T.LongType()))])
    return texts.select(*kept, tx.spaced_tokens(F.col(text_col)).alias("__t")).mapInArrow(count, schema)


def each_hit(counted: DataFrame) -> DataFrame:
    """Rows of ``counted_keys``, one for each hit: its ``key`` (the place in the list) and ``tf`` instead of ``hits``."""
    kept = [c for c in counted.columns if c != "hits"]
    # an outer explode: Spark would give a plain one a filter, and so a shuffle of its own
    return counted.select(*kept, F.explode_outer("hits").alias("__hit")).where("__hit IS NOT NULL").select(*kept, F.shiftright("__hit", 32).cast("int").alias("key"), F.col("__hit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tf"))


def _listed(keys: DataFrame) -> list[str] | None:
    """The keys in order, None if they take more than a broadcast may."""
    return sorted(keys.toArrow().column("key").to_pylist()) if stored_bytes(keys) <= BROADCAST_BYTES else None


def _placed(terms: DataFrame, words: list[str]) -> DataFrame:
    """``terms`` with each key's place in the list instead of the key."""
    places = terms.sparkSession.createDataFrame(pa.table({"__place": pa.array(range(len(words)), pa.int32()), "key": pa.array(words, pa.string())}))
    return terms.join(F.broadcast(places), "key").drop("key").withColumnRenamed("__place", "key")


def bm25_content(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, *, corpus: Column | None = None) -> DataFrame:
    """(q, [corpus,] doc, score, matched, exact): BM25 over the keys (q, term, key), each a term of its own, within each corpus.

    ``matched`` counts the question's words with a key in the document, ``exact`` those with an "=" key. A document leaves
    the scan as its length and its counted keys, and is dealt out so: lengths, counts and scores, and the keys' document
    frequencies, come from that one (reused) shuffle. Keys too many for a broadcast meet the tokens in a join, and those asked
    for are dealt out one by one. A key's weight is joined to a hit before its questions are.
    """
    of = ["corpus"] if corpus is not None else []
    texts = docs.select(F.col(id_col).alias("doc"), *([corpus.alias("corpus")] if of else []), F.col(text_col).alias("text"))
    keys = terms.select("key").distinct()
    asking, words = terms.withColumn("whole", F.col("key").startswith("=")), _listed(keys)
    if words is None:
        lengths = texts.select(*of, tx.count_tokens(F.col("text")).alias("doc_len"), F.lit(1).alias("hits"))
        found = key_matches(each_token(texts, "text"), keys).repartition(*of, "doc").withColumn("tf", F.lit(1))
    else:
        lengths = counted_keys(texts, "text", words).repartition(*of, "doc")
        found, asking = each_hit(lengths), _placed(asking, words)
    # documents are counted by their hits (none is null): a plan that reads fewer columns would not use the same shuffle
    size = lengths.groupBy(*of).agg(F.count("hits").alias("n_docs"), F.greatest(F.avg("doc_len"), F.lit(1e-9)).alias("avg_len"))
    # an id that stands twice has its counts together, as long as its texts have one length
    hits = found.groupBy(*of, "doc", "doc_len", "key").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy(*of, "key").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = (df.join(size, of) if of else df.crossJoin(F.broadcast(size))).select(*of, "key", idf.alias("idf"), "avg_len")
    # no more rows than corpora times keys, which are counted without a look at the texts
    most = keys.crossJoin(texts.select("corpus").distinct()) if of else keys
    rated = F.broadcast(rated) if stored_bytes(most) <= BROADCAST_BYTES else rated
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    weighed = hits.join(rated, [*of, "key"]).select(*of, "doc", "key", weight.alias("weight"))
    # a question has few words: the ones a document has are a set of bits
    bit = F.expr("shiftleft(1L, cast(dense_rank() OVER (PARTITION BY q ORDER BY term) - 1 AS INT))")
    asked = asking.select("q", "key", bit.alias("bit"), "whole")
    return weighed.join(small(asked), "key").groupBy("q", *of, "doc").agg(
        F.sum("weight").alias("score"), F.bit_count(F.bit_or("bit")).alias("matched"), F.bit_count(F.bit_or(F.when(F.col("whole"), F.col("bit")).otherwise(F.lit(0).cast("long")))).alias("exact")
    )


def bm25(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, doc, score, matched): BM25 of every document that shares one of the terms (q, term) itself."""
    return bm25_content(docs, exact_keys(terms), id_col, text_col).drop("exact")


def field_weighted_tf(docs: DataFrame, terms: DataFrame, id_col: str, title_col: str, body_col: str) -> DataFrame:
    """(q, doc, score): twice the matches in the title plus those in the body, over a term's forms; documents without one are left out.

    ``terms`` is (q, term) or (q, term, key); starts ("^") don't count here.
    """
    keyed = terms.where(F.col("key").startswith("=")) if "key" in terms.columns else exact_keys(terms)
    keys = keyed.select("key").distinct()
    words = _listed(keys)
    texts = lambda c: docs.select(F.col(id_col).alias("doc"), F.col(c).alias("text"))
    if words is None:
        side = lambda c, w: each_token(texts(c), "text").select("doc", "token", F.lit(w).alias("weight"))
        found = key_matches(side(title_col, 2).unionByName(side(body_col, 1)), keys).repartition("doc").withColumn("tf", F.lit(1))
    else:
        side = lambda c, w: counted_keys(texts(c), "text", words).select("doc", "hits", F.lit(w).alias("weight"))
        found, keyed = each_hit(side(title_col, 2).unionByName(side(body_col, 1)).repartition("doc")), _placed(keyed, words)
    hits = found.groupBy("doc", "key").agg(F.sum(F.col("weight") * F.col("tf")).alias("weight"))
    return hits.join(small(keyed.select("q", "key")), "key").groupBy("q", "doc").agg(F.sum("weight").alias("score"))


def coverage_gate(scored: DataFrame, terms: DataFrame) -> DataFrame:
    """Keeps candidates that match enough of the query's n terms: all of one or two, else half, rounded up."""
    n = terms.groupBy("q").agg(F.count("*").alias("n"))
    need = F.when(F.col("n") <= 2, F.col("n")).otherwise(F.ceil(F.col("n") / 2))
    return scored.join(n, "q").where(F.col("matched") >= need).drop("n")


def language_gate(scored: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Keeps a candidate in another language than its question's only if every term is matched by an exact form.

    scored: (q, doc, exact, ...); asked: (q, n_terms, q_lang); texts: (doc, doc_lang). Without a language on either side all stay.
    """
    joined = scored.join(asked, "q").join(texts, "doc", "left")
    other = F.col("q_lang") != F.col("doc_lang")
    return joined.where(~F.coalesce(other, F.lit(False)) | (F.col("exact") == F.col("n_terms"))).drop("n_terms", "q_lang", "doc_lang")


def unfounded(pool: DataFrame, served: DataFrame, matches: DataFrame, terms: DataFrame) -> DataFrame:
    """Drops all of a query's ``served`` rows if the corpus does not hold its subject.

    pool and served: (q, doc, ...); matches: (q, doc, term) of the pool; terms: (q, term). With eight or more in the pool
    and three or more terms, one of which nothing in the pool has, some served row must have a term that at most half of
    the pool has.
    """
    size = pool.groupBy("q").agg(F.count("*").alias("pool"))
    df = matches.join(pool.select("q", "doc"), ["q", "doc"]).groupBy("q", "term").agg(F.count("*").alias("df"))
    rated = terms.select("q", "term").distinct().join(df, ["q", "term"], "left").join(size, "q").select("q", "term", F.coalesce("df", F.lit(0)).alias("df"), "pool")
    weak = rated.groupBy("q").agg(F.max("pool").alias("pool"), F.count("*").alias("n"), F.min("df").alias("low")).where("pool >= 8 AND n >= 3 AND low = 0").select("q")
    telling = rated.where("df > 0 AND 2 * df <= pool").select("q", "term")
    founded = matches.join(telling, ["q", "term"]).join(served.select("q", "doc"), ["q", "doc"]).select("q").distinct()
    return served.join(weak.join(founded, "q", "left_anti"), "q", "left_anti")


def top_k(frame: DataFrame, k: int, *, by: str = "q", score: str = "score", ties: str = "doc") -> DataFrame:
    """The k best of each group with their ``rank`` from 1; ties in ascending order of ``ties``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), ties))
    return frame.withColumn("rank", rank).where(F.col("rank") <= k)


def score_floor(frame: DataFrame, floor: float) -> DataFrame:
    """Keeps scores at or over an absolute floor."""
    return frame.where(F.col("score") >= floor)


def margin_prune(frame: DataFrame, *, by: str = "q", margin: float = 0.4, least: int = 1, ties: str = "doc") -> DataFrame:
    """Drops scores under max - margin (max - min) of the group; groups of ``least`` or fewer, or flat ones, stay; ``least`` rows always do."""
    ends = frame.groupBy(by).agg(F.max("score").alias("__high"), F.min("score").alias("__low"), F.count("*").alias("__n"))
    first = top_k(frame, least, by=by, ties=ties).select(by, ties, F.lit(True).alias("__first"))
    flat = (F.col("__high") - F.col("__low") <= 1e-9) | (F.col("__n") <= least)
    near = F.col("score") >= F.col("__high") - margin * (F.col("__high") - F.col("__low"))
    marked = frame.join(ends, by).join(first, [by, ties], "left")
    return marked.where(flat | near | F.col("__first")).drop("__high", "__low", "__n", "__first").select(*frame.columns)


def background(floor: float, gap: float) -> tuple[int, int, float, float] | None:
    """What ``similarity.similar`` needs to leave out the rows that ``distinct_floor`` drops anyway: ranks, floor and gap; None without a gap."""
    return (11, 50, floor, gap) if gap > 0 else None


def distinct_floor(frame: DataFrame, floor: float, gap: float, *, by: str = "q", ties: str = "doc") -> DataFrame:
    """Keeps scores at or over the floor; with a gap and over 50 rows, also over the mean of ranks 11 to 50 plus the gap.

    Of ``similarity.similar``'s rows it needs those that ``apart=background(floor, gap)`` leaves, no others.
    """
    n = frame.groupBy(by).agg(F.count("*").alias("__n"))
    back = top_k(frame, 50, by=by, ties=ties).where("rank > 10").groupBy(by).agg(F.avg("score").alias("__back"))
    bar = F.when((F.lit(gap) > 0) & (F.col("__n") > 50), F.greatest(F.lit(floor), F.col("__back") + gap)).otherwise(F.lit(floor))
    return frame.join(n, by).join(back, by, "left").where(F.col("score") >= bar).select(*frame.columns)


def normalise(frame: DataFrame, *, by: list[str], score: str = "score", out: str = "norm") -> DataFrame:
    """Sigmoid of the z-score in each group; of fewer than three or of equal scores, half the share of the greatest."""
    ends = frame.groupBy(*by).agg(F.avg(score).alias("__mean"), F.stddev_pop(score).alias("__sd"), F.max(score).alias("__high"), F.count("*").alias("__n"))
    few = 0.5 * F.col(score) / F.greatest(F.col("__high"), F.lit(1e-9))
    value = F.when((F.col("__n") < 3) | (F.col("__sd") <= 1e-6), few).otherwise(1 / (1 + F.exp(-(F.col(score) - F.col("__mean")) / F.col("__sd"))))
    return frame.join(ends, by).withColumn(out, value).select(*frame.columns, out)


def fuse(lexical: DataFrame, semantic: DataFrame, *, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(q, doc, score, match, raw): each side over its greatest, weighted, added by document.

    match tells which sides had it; raw is the semantic side's own score, null if it had none.
    """

    def side(frame: DataFrame, name: str, weight: float) -> DataFrame:
        high = frame.groupBy("q").agg(F.greatest(F.max("score"), F.lit(1e-9)).alias("__high"))
        part = (F.col("score") / F.col("__high") * weight).alias("part")
        return frame.select("q", "doc", "score").join(high, "q").select("q", "doc", part, F.lit(name).alias("side"), F.when(F.lit(name == "semantic"), F.col("score")).alias("raw"))

    both = side(lexical, "lexical", weights[0]).unionByName(side(semantic, "semantic", weights[1]))
    match = F.when(F.countDistinct("side") == 2, F.lit("hybrid")).otherwise(F.max("side"))
    return both.groupBy("q", "doc").agg(F.sum("part").alias("score"), match.alias("match"), F.max("raw").alias("raw"))


def reserve(fused: DataFrame, k: int, article: Column, own: Column, *, most: int = 2, factor: float = 1.25) -> DataFrame:
    """The k best of each query with ``rank``, at most ``most`` of an article; if none is the user's own, their best one takes the
    last place, provided that its score times ``factor`` reaches the last one's and its article has room.

    fused: (q, doc, score, ...), article and own: columns of it.
    """
    rows = fused.withColumns({"__article": article, "__own": F.coalesce(own, F.lit(False))})
    capped = F.row_number().over(Window.partitionBy("q", "__article").orderBy(F.desc("score"), "doc"))
    kept = top_k(rows.withColumn("__place", capped).where(F.col("__place") <= most).drop("__place"), k)
    state = kept.groupBy("q").agg(F.max("__own").alias("__has"), F.count("*").alias("__n"), F.min("score").alias("__last"))
    best = top_k(rows.where("__own"), 1).drop("rank")
    taken = kept.groupBy("q", "__article").agg(F.count("*").alias("__taken"))
    fits = (F.coalesce("__taken", F.lit(0)) < most) & ((F.col("__n") < k) | (F.col("__last") <= F.col("score") * factor))
    placed = best.join(state, "q").join(taken, ["q", "__article"], "left").where(~F.col("__has") & fits)
    entering = placed.select(*rows.columns, F.least(F.col("__n") + 1, F.lit(k)).cast("int").alias("rank"))
    out = kept.join(entering.select("q", "rank"), ["q", "rank"], "left_anti").select(*entering.columns).unionByName(entering)
    return out.drop("__article", "__own")


def absolute_gate(fused: DataFrame, coverage: DataFrame, floor: float, own: Column) -> DataFrame:
    """After fusion: rows with a semantic score need ``floor``; others more than half of the terms (coverage: q, doc, share), or to be the user's own."""
    joined = fused.join(coverage.select("q", "doc", F.col("share").alias("__share")), ["q", "doc"], "left")
    lexical = F.col("__share").isNull() | (F.col("__share") > 0.5) | F.coalesce(own, F.lit(False))
    return joined.where(F.when(F.col("raw").isNotNull(), F.col("raw") >= floor).otherwise(lexical)).select(*fused.columns)


def cap_groups(frame: DataFrame, group: Column, most: int = 2, *, by: str = "q", ties: str = "doc") -> DataFrame:
    """At most ``most`` rows of each group (an article, say) for each query, by score."""
    of, place = spare(frame, "__group"), spare(frame, "__place")
    rank = F.row_number().over(Window.partitionBy(by, of).orderBy(F.desc("score"), ties))
    return frame.withColumn(of, group).withColumn(place, rank).where(F.col(place) <= most).drop(of, place)


def evaluate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(q, hit1, hit3, hit6, all_found, rr) from (q, doc, rank) and the expected (q, doc) pairs; queries without any are left out."""
    joined = expected.join(ranked.select("q", "doc", "rank"), ["q", "doc"], "left")
    best = F.min("rank")
    hit = lambda k: F.coalesce(best <= k, F.lit(False))
    return joined.groupBy("q").agg(hit(1).alias("hit1"), hit(3).alias("hit3"), hit(6).alias("hit6"), (F.count("rank") == F.count("*")).alias("all_found"), F.coalesce(1 / best, F.lit(0.0)).alias("rr"))


def recall_by_language(queries: DataFrame, served: DataFrame) -> DataFrame:
    """(lang, recall, false_rate): answerable questions with a hit, and others with anything served; null where there is none.

    queries: (q, lang, answerable); served: (q, hit, ...).
    """
    got = served.groupBy("q").agg(F.bool_or("hit").alias("found"), F.lit(True).alias("got"))
    each = queries.join(got, "q", "left").select("lang", "answerable", F.coalesce("found", F.lit(False)).cast("int").alias("found"), F.coalesce("got", F.lit(False)).cast("int").alias("got"))
    return each.groupBy("lang").agg(F.avg(F.when(F.col("answerable"), F.col("found"))).alias("recall"), F.avg(F.when(~F.col("answerable"), F.col("got"))).alias("false_rate"))


def choose_floor(queries: DataFrame, served: DataFrame, grid: list[float], most_false: float) -> DataFrame:
    """(floor, recall, false_rate) of the floor with the greatest mean recall over languages among those whose mean of false accepts is in bounds; ties: the highest.

    A question counts up to its best hit's and its best row's score, so each is looked at once for all floors of the grid.
    """
    best = served.groupBy("q").agg(F.max(F.when(F.col("hit"), F.col("score"))).alias("hit"), F.max("score").alias("top"))
    each = queries.join(best, "q", "left").withColumn("floor", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    reached = lambda c: F.coalesce(F.col(c) >= F.col("floor"), F.lit(False)).cast("int")
    by_lang = each.groupBy("floor", "lang").agg(F.avg(F.when(F.col("answerable"), reached("hit"))).alias("recall"), F.avg(F.when(~F.col("answerable"), reached("top"))).alias("fa"))
    means = by_lang.groupBy("floor").agg(F.avg("recall").alias("recall"), F.coalesce(F.avg("fa"), F.lit(0.0)).alias("fa")).where(F.col("fa") <= most_false + 1e-9)
    return means.orderBy(F.round("recall", 9).desc(), F.desc("floor")).limit(1).select("floor", F.round("recall", 6).alias("recall"), F.round("fa", 6).alias("false_rate"))
