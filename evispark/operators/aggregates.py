"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's values are cut into.
PARTS = 64


def finite(value: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _cuts(counted: DataFrame) -> DataFrame:
    """(g, cuts, n) of the distinct values (g, v, c): PARTS values at most, chosen by their hashes, in ascending order, and the sum of c.

    The same values give the same cuts, however they are dealt and merged: a plan that reads its cuts twice, or a task that is
    repeated, must not get others (approximate quantiles depend on the order of merging).
    """
    hashed = F.xxhash64("v")
    chosen = counted.groupBy("g", F.pmod(hashed, F.lit(PARTS)).alias("bucket")).agg(F.min_by("v", F.struct(hashed, F.col("v"))).alias("v"), F.sum("c").alias("c"))
    return chosen.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("cuts"), F.sum("c").alias("n"))


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, one column for each rank): the values at these 1-based ranks (expressions of ``n``) among a group's finite values.

    Values are counted first (map-side). ``_cuts`` part a group, and the parts' sizes tell how many values lie before
    each; inside a part a running sum of counts gives exact ranks. So a group of any size is spread over its parts.
    """
    counted = df.where(finite(F.col(value).cast("double"))).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cuts = _cuts(counted)
    same = F.col("x.g").eqNullSafe(F.col("y.g"))
    placed = counted.alias("x").join(cuts.alias("y"), same).select("x.g", "v", "c", "n", F.size(F.filter("cuts", lambda q: q < F.col("v"))).alias("part"))
    sizes = placed.groupBy("g", "part").agg(F.sum("c").alias("size"))
    before = sizes.select("g", "part", (F.sum("size").over(Window.partitionBy("g").orderBy("part")) - F.col("size")).alias("before"))  # PARTS rows a group
    running = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v"))
    here = placed.withColumn("running", running).alias("x").join(before.alias("y"), same & (F.col("x.part") == F.col("y.part")))
    ended = here.select("x.g", "v", "n", (F.col("running") + F.col("before")).alias("last"))
    return ended.groupBy("g").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("last") >= r, F.col("v"))).alias(name) for name, r in ranks.items())).withColumnRenamed("g", by)


def percentiles(df: DataFrame, by: str, value: str, points: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, n, one column for each point): kinds are "nearest" (rank ceil(p n)), "floor" (rank floor(p n) + 1) and "between" (linear interpolation)."""
    n, ranks = F.col("n"), {}
    whole = lambda c: F.least(n, F.greatest(F.lit(1), c)).cast("long")
    for name, (kind, p) in points.items():
        if kind == "between":
            ranks[f"__low_{name}"], ranks[f"__high_{name}"] = whole(F.floor((n - 1) * p) + 1), whole(F.ceil((n - 1) * p) + 1)
        else:
            ranks[name] = whole(F.ceil(n * p) if kind == "nearest" else F.floor(n * p) + 1)
    found = at_ranks(df, by, value, ranks)
    between = lambda name, p: (F.col(f"__low_{name}") + (F.col(f"__high_{name}") - F.col(f"__low_{name}")) * ((n - 1) * p - F.floor((n - 1) * p))).alias(name)
    return found.select(by, "n", *(between(name, p) if kind == "between" else F.col(name) for name, (kind, p) in points.items()))


def route_sweep(cases: DataFrame, family: str, expected: str, routed: str, fallbacks: dict[str, str]) -> DataFrame:
    """(family, expected, routed, total, ok, one column for each of ``fallbacks``, wrong_route) by family, by (expected, routed), and in all, from one pass.

    A case that went elsewhere than expected is counted under the fallback it went to, else as a wrong route. Null routes are counted in total only.
    """
    astray = F.col(expected) != F.col(routed)
    to = {name: F.count_if(astray & (F.col(routed) == route)).alias(name) for name, route in fallbacks.items()}
    counts = [F.count("*").alias("total"), F.count_if(F.col(expected) == F.col(routed)).alias("ok"), *to.values(), F.count_if(astray & ~F.col(routed).isin(*fallbacks.values())).alias("wrong_route")]
    sets = [[F.col(family)], [F.col(expected), F.col(routed)], []]
    return cases.groupingSets(sets, F.col(family), F.col(expected), F.col(routed)).agg(*counts)


def locale_order(words: DataFrame, column: str, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """(initial, word, spellings, rank): words that the collation takes for one, the first of their spellings, and their place among those of their initial.

    Ranks are within an initial (letters as the collation has them), so that no task holds all words.
    """
    one = F.collate(F.col(column), collation)
    groups = words.groupBy(one.alias("one")).agg(F.min(F.collate(F.col(column), "UTF8_BINARY")).alias("word"), F.count("*").alias("spellings"))
    plain = F.lower(F.collate("word", "UTF8_BINARY"))
    initial = F.translate(F.substring(plain, 1, 1), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    rank = F.row_number().over(Window.partitionBy("initial").orderBy("one"))
    return groups.withColumn("initial", initial).withColumn("rank", rank).select("initial", "word", "spellings", "rank")
