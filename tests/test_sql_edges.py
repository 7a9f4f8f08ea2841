"""Queries that differed from their SQL on other tables than the small ones."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_oracles import rows

from evispark.operators import aggregates as ag
from evispark.plans import registry


def same_as_sql(spark, folder, name, **tables):
    duck = duckdb.connect()
    for table, data in tables.items():
        pq.write_table(data, f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)), duck.sql(registry.ORACLE_SQL[name])
    expected = rows(want.columns, want.fetchall())
    found = rows(got.columns, got.collect())
    assert found == expected
    return found


def test_cuts_of_a_group_do_not_depend_on_how_it_is_dealt(spark):
    counted = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 50_021 / 100).alias("v"), F.lit(1).alias("c"))
    of = lambda df: {r.g: (r.cuts, r.n) for r in ag._cuts(df).collect()}
    assert of(counted.repartition(3, "v")) == of(counted.repartition(17, F.col("v") % 5)) == of(counted.orderBy(F.desc("v")))
    assert all(len(cuts) == ag.PARTS for cuts, _ in of(counted).values())


def test_cycle_counts_whole_milliseconds(spark, tmp_path):
    times = [datetime.datetime(2024, 1, 3, 0, 58, 7, 999734), datetime.datetime(2024, 1, 3, 0, 58, 8), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    same_as_sql(spark, tmp_path, "d_cycle", events=pa.table({"event_id": [1, 2, 3], "ts": pa.array(times, pa.timestamp("us"))}))


def test_alias_of_a_word_that_an_accent_parts(spark, tmp_path):
    benchmark = pa.table({"item_id": [1, 2, 3], "text": ["Ción de algo", "ás tion", "plain words"]})
    documents = pa.table({"doc_id": [1, 2, 3], "text": ["La Ción es", "no tion here", "Cion en Ci n"]})
    found = same_as_sql(spark, tmp_path, "r_aliases", benchmark=benchmark, documents=documents)
    assert len(found) >= 2


def test_rates_of_a_window_with_a_still_stretch(spark, tmp_path):
    events = pq.read_table("/root/testdata/sf0.1/events.parquet", filters=[("user_id", "in", [227, 656])])
    same_as_sql(spark, tmp_path, "s_sliding_rates", events=events)
