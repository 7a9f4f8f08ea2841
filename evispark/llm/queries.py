"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import (
    alignment,
    conversation_sql,
    conversations,
    decontaminate,
    html_text,
    language,
    line_dedup,
    near_dup,
    neighbours,
    piece_model,
    secret_scan,
    token_counts,
    token_records,
    toxicity,
)
from evispark.llm.tables import bound_batches, shared_folder


def vocabulary(name: str) -> str:
    """Where the named public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-records-{uuid.uuid4().hex}"
    token_records.write_records(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_records.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_model.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digest=True)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language.identify(docs, language.train(docs, ~held_out), spans=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["kind"].isin(*secret_scan.PATTERNS))
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, secret_scan.PATTERNS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    counted = alignment.with_counts(found, alignment.link_counts(found))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")), present="present")
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return found.withColumn("repaired_sha256", F.sha2(F.concat_ws("\n", lines), 256)).drop("repaired")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_records,
        op2_html_text,
        op3_decontaminate,
        op4_neighbours,
        op5_near_duplicates,
        op6_line_dedup,
        op7_token_counts,
        op8_toxicity,
        op9_sentencepiece,
        op10_language,
        op11_secrets,
        op12_alignment,
        op13_conversation_repair,
        pipeline,
    )
}

#: The others have no form in SQL that ends on whole tables; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {"op13_conversation_repair": conversation_sql.SQL}
