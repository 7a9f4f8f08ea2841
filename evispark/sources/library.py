"""A stored library of documents that knows what it has: imports decide by content, and may be repeated.

A library is a folder of Parquet tables, one directory for each batch:

    documents/batch=<n>   doc_id, print, text, keys   what was taken in
    decisions/batch=<n>   doc_id, decision, other, share   what was decided on each row of the batch
    prints/batch=<n>      doc_id, print, keys, tag, n   what the batch held, without its texts: decisions are made from it

``import_batch`` meets a batch with all that other batches brought. Its directories are written anew, so a batch that is
repeated (a stream that recovers hands its last one out again) replaces its own rows and is decided on as before, and
one that failed half-way is mended by its repetition. No row of an earlier batch is ever written.

Decisions, in the order (batch, doc_id): *same* if a document before it has its fingerprint (its words, white space levelled);
it is not taken in. *similar* if one before it that was taken in shares PERCENT of the longer one's chunks, copies counted;
``other`` is the most similar one (the earliest of these), and it is taken in. *new* otherwise, *empty* without text; an
empty one isn't taken in. Null texts are empty; a null doc_id is an error; repeated rows of a doc_id are documents of their
own with one id, decided on together: the row with the least fingerprint stands for the id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evispark.functions import text as tx
from evispark.operators.sizes import small

PERCENT = 90
_DOCUMENTS = "doc_id long, print string, text string, keys array<bigint>, batch long"
_PRINTS = "doc_id long, print string, keys array<bigint>, tag long, n long"
_DECISIONS = "doc_id long, decision string, other long, share double, batch long"


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """What the library has: doc_id, print, text, keys (of its chunks), batch."""
    return _stored(spark, path, "documents", _DOCUMENTS)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """What was decided on every row of every batch: doc_id, decision, other, share, batch."""
    return _stored(spark, path, "decisions", _DECISIONS)


def content_print(text: Column) -> Column:
    """The fingerprint of a text; null of one without a word."""
    return F.when(F.length(F.regexp_replace(text, r"\s+", "")) > 0, tx.fingerprint(text))


def chunk_keys(text: Column) -> Column:
    """A key for each chunk of the text, equal ones told apart by their number, in ascending order."""
    numbered = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, (i + 2 - F.array_position(h, x)).cast("int")))
    prints = F.array_sort(F.transform(tx.chunks(text), tx.fingerprint))
    return F.array_sort(F.get(F.transform(F.array(prints), numbered), F.lit(0)))


def _rows(batch: DataFrame) -> DataFrame:
    unknown = F.raise_error(F.lit("a document to import has no doc_id"))
    rows = batch.select(F.coalesce(F.col("doc_id").cast("long"), unknown).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("print", content_print(F.col("text")))


def prints(batch: DataFrame) -> DataFrame:
    """(doc_id, print, keys, tag, n) of a batch's documents, without their texts: tag tells the row that stands for the id from its other n - 1."""
    rows = _rows(batch).select("doc_id", "print", F.when(F.col("print").isNotNull(), chunk_keys(F.col("text"))).alias("keys"), F.xxhash64("text").alias("tag"))
    first = F.min_by(F.struct("print", "keys", "tag"), F.when(F.col("print").isNotNull(), F.struct("print", "tag")))
    return rows.groupBy("doc_id").agg(first.alias("r"), F.count("*").alias("n")).select("doc_id", "r.*", "n")


def _most_similar(fresh: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """(doc_id, other, share) of the fresh documents that are similar to a stored one or to a fresh one before them.

    A document that shares enough with another has one of the other's keys among any n - need + 1 of its own: the rarest
    of them are looked for, so that a chunk that many documents hold is hardly ever a meeting place.
    """
    place = lambda df, batch: df.select(F.struct(batch.alias("batch"), "doc_id").alias("at"), "keys", F.size("keys").alias("m"))
    known = place(stored, F.col("batch")).unionByName(place(fresh, F.lit(1 << 62)))
    index = known.select("at", "m", F.explode("keys").alias("key"))
    mine = fresh.select("doc_id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    met_by = index.join(mine.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "key"))
    prefix = mine.join(met_by, "key").withColumn("i", rare).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    before = (F.col("at.batch") < (1 << 62)) | (F.col("at.doc_id") < F.col("doc_id"))
    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = prefix.join(index, "key").where(before & near).select("doc_id", "at").distinct()
    both = pairs.join(fresh.select("doc_id", F.col("keys").alias("x")), "doc_id").join(known.select("at", F.col("keys").alias("y")), "at")
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    found = both.select("doc_id", "at", share.alias("share")).where(F.col("share") * 100 >= percent)
    best = F.max_by("at", F.struct("share", -F.col("at.batch"), -F.col("at.doc_id")))
    return found.groupBy("doc_id").agg(best["doc_id"].alias("other"), F.max("share").alias("share"))


def decide(batch: DataFrame, stored: DataFrame, *, percent: int = PERCENT, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, documents to take in) of a batch (doc_id, text) that meets ``stored`` (doc_id, print, keys, batch).

    ``known``: the batch's ``prints``, if they are at hand. Decisions need no text, and texts that are taken in stay where they
    are read as long as the ids of the others are few (``small``); only rows of a repeated doc_id are brought together.
    """
    rows = prints(batch) if known is None else known
    first = rows.where("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first"))
    old = stored.groupBy("print").agg(F.min_by("doc_id", F.struct("batch", "doc_id")).alias("old"))
    taken = F.coalesce(F.col("print").isNotNull() & F.col("old").isNull() & (F.col("first") == F.col("doc_id")), F.lit(False))
    seen = rows.join(first.join(old, "print", "left"), "print", "left").withColumn("taken", taken)
    similar = _most_similar(seen.where("taken").select("doc_id", "keys"), stored, percent)
    same = F.when(F.col("old").isNotNull(), F.col("old")).when(F.col("first") != F.col("doc_id"), F.col("first"))
    marked = seen.select("doc_id", "print", same.alias("same")).join(similar, "doc_id", "left")
    decision = F.when(F.col("print").isNull(), "empty").when(F.col("same").isNotNull(), "same").when(F.col("other").isNotNull(), "similar").otherwise("new")
    decided = marked.select("doc_id", decision.alias("decision"), F.coalesce("same", "other").alias("other"), F.when(F.col("same").isNull(), F.col("share")).alias("share"))

    texts = _rows(batch)
    single = texts.join(small(seen.where("NOT taken OR n > 1").select("doc_id")), "doc_id", "left_anti").select("doc_id", "text")
    repeated = texts.withColumn("tag", F.xxhash64("text")).join(small(seen.where("taken AND n > 1").select("doc_id", "tag")), ["doc_id", "tag"])
    fresh = single.unionByName(repeated.groupBy("doc_id").agg(F.min("text").alias("text")))
    return decided, fresh.select("doc_id", content_print(F.col("text")).alias("print"), "text", chunk_keys(F.col("text")).alias("keys"))


def import_batch(spark: SparkSession, path: str, batch: DataFrame, number: int, *, percent: int = PERCENT) -> None:
    """Takes a batch (doc_id, text) into the library at ``path``; the same number again replaces what it brought."""
    at = f"{path}/prints/batch={number}"
    prints(batch).write.mode("overwrite").parquet(at)
    others = documents(spark, path).where(F.col("batch") != number)
    decided, fresh = decide(batch, others, percent=percent, known=spark.read.schema(_PRINTS).parquet(at))
    fresh.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    decided.write.mode("overwrite").parquet(f"{path}/decisions/batch={number}")


def import_stream(stream: DataFrame, path: str, checkpoint: str, *, percent: int = PERCENT) -> DataStreamWriter:
    """A writer that imports each micro-batch of a stream (doc_id, text); start it with the trigger you want."""

    def take(batch: DataFrame, number: int) -> None:
        import_batch(batch.sparkSession, path, batch, number, percent=percent)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def backfill(chunks: DataFrame, known: DataFrame, *, notes: list[str] | None = None, overlap: int = 200) -> DataFrame:
    """(collection, doc_id, print, twin_of) of the documents of ``chunks`` (collection, doc_id, pos, body) that ``known`` (collection, doc_id) lacks.

    A body is put together again from its overlapping chunks, without a note that was put in front of the first. twin_of is the
    first document (by collection, then id; of all that are given) with the same print, null of the first itself. Nothing is removed. Bodies without a word have no print.
    """
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda c: F.coalesce(c["body"], F.lit("")))
    whole = chunks.groupBy("collection", "doc_id").agg(tx.stitched(pieces, overlap).alias("body"))
    body = F.col("body")
    for note in notes or []:
        body = F.when(F.startswith("body", F.lit(note)), F.substring("body", F.lit(len(note) + 1), F.length("body"))).otherwise(body)
    printed = whole.select("collection", "doc_id", content_print(body).alias("print"))
    here = F.struct("collection", "doc_id")
    firsts = printed.where("print IS NOT NULL").groupBy("print").agg(F.min(here).alias("first"))
    twins = printed.join(firsts, "print", "left").withColumn("twin_of", F.when(F.col("first") != here, F.col("first.doc_id")))
    return twins.select("collection", "doc_id", "print", "twin_of").join(known.select("collection", "doc_id"), ["collection", "doc_id"], "left_anti")
