"""Names in texts, names of people, facts of several packs, and copies among documents and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators.sizes import small


def _spaced(text: Column, fold: bool) -> Column:
    """Words with one space around each."""
    plain = tx.fold(text) if fold else text
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, "[^a-z0-9]+" if fold else "[^A-Za-z0-9]+", " ")), F.lit(" "))


def longest_alias(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity, alias): the entity whose longest alias stands in the text (equal lengths: the smaller entity).

    aliases: (entity, alias); one with capitals is matched as written, others ignore case and accents. Texts meet only
    the aliases whose first word they have, by an equi-join: a word as written (where an accent parts words) or a folded one.
    """
    cased = F.col("alias") != F.lower("alias")
    known = aliases.select("entity", "alias", cased.alias("cased"), F.when(cased, _spaced(F.col("alias"), False)).otherwise(_spaced(F.col("alias"), True)).alias("needle"))
    known = known.where(F.length(F.trim("needle")) >= 2).withColumn("word", F.lower(F.split_part(F.trim("needle"), F.lit(" "), F.lit(1))))
    rows = texts.select(F.col(id_col).alias("id"), _spaced(F.col(text_col), True).alias("low"), _spaced(F.col(text_col), False).alias("high"))
    split = lambda c: F.split(F.trim(c), " ")
    words = rows.select("id", F.explode(F.array_union(split("low"), split(F.lower("high")))).alias("word"))
    met = words.join(small(known), "word").drop("word")
    there = F.when(F.col("cased"), F.contains("high", "needle")).otherwise(F.contains("low", "needle"))
    found = met.join(rows, "id").where(there)
    best = F.max(F.struct(F.length("needle").alias("size"), (-F.col("entity")).alias("entity"), "alias"))
    return found.groupBy("id").agg(best.alias("b")).select("id", (-F.col("b.entity")).alias("entity"), "b.alias")


def resolve_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(q, kind, id): ok with the one whose name is the same (ignoring case, accents and spaces), not_found, or ambiguous. asked: (q, name); known: (id, name)."""
    key = lambda c: F.trim(F.regexp_replace(tx.fold(F.col(c)), r"\s+", " "))
    counted = known.groupBy(key("name").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    joined = asked.select("q", key("name").alias("k")).join(counted, "k", "left")
    hit = F.col("n").isNotNull() & (F.col("k") != "")
    kind = F.when(~hit, "not_found").when(F.col("n") == 1, "ok").otherwise("ambiguous")
    return joined.select("q", kind.alias("kind"), F.when(hit & (F.col("n") == 1), F.col("id")).alias("id"))


def merge_packs(facts: DataFrame, *, shared: str = "emergency.") -> DataFrame:
    """Facts (pack, region, key, ...) of several packs: a region is its first pack's; later packs add keys that don't begin with ``shared`` and that no pack before had."""
    owner = facts.groupBy("region").agg(F.min("pack").alias("__owner"))
    allowed = facts.join(owner, "region").where((F.col("pack") == F.col("__owner")) | ~F.startswith("key", F.lit(shared))).drop("__owner")
    first = allowed.groupBy("region", "key").agg(F.min("pack").alias("pack"))
    return allowed.join(first, ["region", "key", "pack"], "left_semi")


def successors(rows: DataFrame, id_col: str, next_col: str, live: Column) -> DataFrame:
    """(id, successor): the row named in ``next_col`` if it is there and alive; one hop, not more."""
    alive = rows.where(live).select(F.col(id_col).alias("successor"))
    return rows.select(F.col(id_col).alias("id"), F.col(next_col).alias("__next")).join(alive, F.col("__next") == F.col("successor"), "left").select("id", "successor")


def without_copies(ranked: DataFrame, *, share: float = 0.6) -> DataFrame:
    """(q, doc) of the rows of (q, doc, rank, title, body) that copy no kept one above them: the same title, and at least ``share`` of either's word pairs in the other.

    Only rows of one query and title meet, each with those kept, in order of rank: a fold over a few rows of a ranked list.
    """
    title = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    rows = ranked.select("q", title.alias("t"), F.struct("rank", "doc", tx.word_bigrams(F.coalesce("body", F.lit(""))).alias("pairs")).alias("x"))
    group = rows.groupBy("q", "t").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    copies = lambda k, x: F.size(F.array_intersect(k["pairs"], x["pairs"])) >= F.greatest(F.lit(1), F.ceil(share * F.least(F.size(k["pairs"]), F.size(x["pairs"])) - 1e-9))
    keep = lambda kept, x: F.when(F.exists(kept, lambda k: copies(k, x)), kept).otherwise(F.array_append(kept, x))
    return group.select("q", F.explode(F.aggregate("xs", F.slice("xs", 1, 0), keep)).alias("x")).select("q", "x.doc")


def similar_documents(docs: DataFrame, id_col: str, text_col: str, *, percent: int = 90) -> DataFrame:
    """(a, b, share): documents whose chunks agree (as multisets) in ``percent`` of the longer one's; of equal documents the smallest id stands for all.

    A set-similarity join: chunks carry their number among equal ones, the rarest of a document's chunks (n - need + 1 of
    them) are its prefix, only documents that share a prefix chunk meet, and the full lists decide.
    """
    key = lambda c, i: F.xxhash64(tx.fingerprint(c), i)
    cut = docs.select(F.col(id_col).alias("id"), tx.fingerprint(F.col(text_col)).alias("print"), tx.chunks(F.col(text_col)).alias("chunks"))
    firsts = cut.groupBy("print").agg(F.min_by("chunks", "id").alias("chunks"), F.min("id").alias("id")).where(F.size("chunks") > 0)
    each = firsts.select("id", F.posexplode("chunks").alias("pos", "chunk")).select("id", "pos", tx.fingerprint(F.col("chunk")).alias("h"))
    copies = F.row_number().over(Window.partitionBy("id", "h").orderBy("pos"))
    keys = each.select("id", F.xxhash64("h", copies).alias("k"))
    df = keys.groupBy("k").agg(F.count("*").alias("df"))
    lists = keys.join(df, "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("s")).select("id", F.transform("s", lambda x: x["k"]).alias("keys"))
    n = F.size("keys")
    prefix = lists.select("id", n.alias("n"), F.explode(F.slice("keys", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)).alias("k"))
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), "k")
    met = prefix.withColumnRenamed("id", "a").join(other, "k").where((F.col("a") < F.col("b")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))).select("a", "b").distinct()
    full = met.join(lists.select(F.col("id").alias("a"), F.col("keys").alias("x")), "a").join(lists.select(F.col("id").alias("b"), F.col("keys").alias("y")), "b")
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    return full.select("a", "b", share.alias("share")).where(F.col("share") >= percent / 100)


def close_words(words: DataFrame, column: str, *, most: int = 2, head: int = 0) -> DataFrame:
    """(a, b, distance): pairs a < b of distinct words at most ``most`` edits apart, with the same first ``head`` letters.

    Two such words have a string in common after at most ``most`` deletions in each, so each word meets others by an
    equi-join on what is left of it, and never all words that begin alike.
    """
    start, rest = F.substring(column, 1, head), F.substring(F.col(column), F.lit(head + 1), F.length(column))
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array(w))
    left = F.array(rest)
    every = left
    for _ in range(most):
        left = F.array_distinct(F.flatten(F.transform(left, shorter)))
        every = F.concat(every, left)
    keyed = words.select(F.col(column).alias("a"), F.explode(F.array_distinct(F.transform(every, lambda r: F.concat(start, F.lit("\x00"), r)))).alias("key")).distinct()
    met = keyed.join(keyed.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most).cast("long")).where("distance >= 0")
