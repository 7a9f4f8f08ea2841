"""All queries of the engine, by name, and the SQL that gives the same rows.

A query is a function of (spark, sf_dir); ``query`` registers it with its SQL, or without where SQL has no form
(then a test compares it with a brute-force version).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evispark.functions import text as tx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(column: str) -> str:
    """DuckDB's form of ``functions.text.tokens``."""
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({column}, '')), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def sql_token_estimate(column: str) -> str:
    """DuckDB's form of the estimate, from its rule: UTF-16 length, digits, numbers, letters beyond U+024F, signs and capitals where they rule."""
    n = lambda pattern: f"len(regexp_extract_all({column}, '{pattern}'))"
    signs = n(r"[!-/:-@\[-`{-~\x{A1}-\x{BF}\x{2010}-\x{2027}]")
    upper, letters = n(r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]"), n(r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{FF}]")
    twice, foreign = n(r"[\x{10000}-\x{10FFFF}]"), n(r"[^\x{0000}-\x{024F}]")
    length = f"(length({column}) + {twice})"
    return (
        f"(ceil({length} / 3 + {n('[0-9]')} * 2 / 3 + {n('[0-9]+')} + ({foreign} + {twice}) * 2 / 3"
        f" + CASE WHEN {signs} > 0.3::DOUBLE * {length} THEN {signs} / 3 ELSE 0 END + CASE WHEN {upper} > 0.5 * {letters} THEN {upper} / 12 ELSE 0 END) + 50)::BIGINT"
    )


from evispark.plans import folds, knowledge, library, measures, records, retrieval, scalars, stores, tabular, texts, upkeep  # noqa: E402, F401
