"""Table operators: filters from text, profiles, keep-last, upserts, retention, diffs, as-of and range joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"^\s*(.+?)\s*(>=|<=|!=|=|>|<)\s*(.*?)\s*$")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_number(cell: Column) -> Column:
    """The number in a cell, with a decimal comma or point; null if it is none."""
    return F.replace(F.trim(cell.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def parse_filter(df: DataFrame, text: str) -> Column:
    """A condition from 'column>=value;other!=value': ; means and, names ignore case, = and != compare trimmed text
    without case, the order operators compare numbers and are false where a side is none."""
    names = {c.lower(): c for c in df.columns}
    conditions = []
    for clause in filter(str.strip, text.split(";")):
        match = _CLAUSE.match(clause)
        if not match or match[1].lower() not in names:
            raise ValueError(f"cannot read the condition {clause!r}")
        cell, op, value = F.col(names[match[1].lower()]), match[2], match[3]
        if op in ("=", "!="):
            same = F.lower(F.trim(cell.cast("string"))) == value.lower()
            conditions.append(F.coalesce(same if op == "=" else ~same, F.lit(op == "!=")))
        else:
            left, right = as_number(cell), as_number(F.lit(value))
            test = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
            conditions.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def melt(df: DataFrame) -> DataFrame:
    """(column, cell) of every cell, as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in df.columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.cell")


def numeric_profile(df: DataFrame) -> DataFrame:
    """(column, n, total, mean, low, high) of the columns whose non-empty cells are all numbers, in one pass."""
    cells = melt(df).where("cell IS NOT NULL AND trim(cell) <> ''").withColumn("number", as_number(F.col("cell")))
    found = cells.groupBy("column").agg(F.count("*").alias("n"), F.count("number").alias("numbers"), F.sum("number").alias("total"), F.avg("number").alias("mean"), F.min("number").alias("low"), F.max("number").alias("high"))
    return found.where("n = numbers").drop("numbers")


def top_values(df: DataFrame, column: str, ordinal: Column, k: int = 5) -> DataFrame:
    """(value, n, rank): the k most frequent values; ties in the order of first appearance."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    best = counted.orderBy(F.desc("n"), "first").limit(k)  # at most k rows reach the window
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    name = spare(df, "__rank")
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key; both have one row for each key."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def patch(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upsert``, but a null in a change keeps the old value."""
    rest = [c for c in base.columns if c not in keys]
    other = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest])
    return base.join(other, keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) for c in rest])


def newest(df: DataFrame, n: int, order: list[Column], by: list[str]) -> DataFrame:
    """The newest n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    name = spare(df, "__rank")
    return df.withColumn(name, rank).where(F.col(name) <= n).drop(name)


def evict(df: DataFrame, by: list[str], order: list[Column], size: str, budget: float) -> DataFrame:
    """The rows to evict, oldest first, until what remains of the group is within the budget."""
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum(size).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = spare(df, "__left")
    return df.withColumn(left, F.sum(size).over(group) - before).where(F.col(left) > budget).drop(left)


def within_budget(df: DataFrame, by: list[str], newest_first: list[Column], cost: str, budget: float) -> DataFrame:
    """The newest rows whose costs, added up from the newest, stay within the budget."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    name = spare(df, "__running")
    return df.withColumn(name, running).where(F.col(name) <= budget).drop(name)


def _linear(df: DataFrame, time: str) -> Column:
    """A time (or number) as a double that keeps its order."""
    kind = df.schema[time].dataType.typeName()
    return F.unix_micros(F.col(time).cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else F.col(time).cast("double")


def next_event(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    value: str,
    *,
    strict: bool = False,
    within: str | None = None,
    ties: list[str] | None = None,
    cells: int = 256,
) -> DataFrame:
    """Forward as-of join: each left row with the earliest right time at or after it (after it, if strict), as ``next_time`` and ``next_value``.

    Of right rows at one time the first by ``ties`` (columns of ``right``; its value if none are given) counts. Null keys and
    times meet nothing. ``within`` (an interval) bounds the distance. Left columns keep their names, whatever ``right`` has.

    Linear in a key's rows: both sides are stacked and sorted once, latest first, so that a frame which only grows carries
    the last right row seen. Time is cut into ``cells`` equal parts, so a busy key is sorted in as many tasks; a
    small table of each key's first right row of each cell (no more than keys x cells rows) gives what lies in later cells.
    """
    payload = [c for c in left.columns if c not in keys]
    at = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    known = right.where(F.col(right_time).isNotNull()).dropna(subset=keys)
    hit = F.struct(F.col(right_time).alias("time"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties or [value])], F.col(value).alias("value"))
    own = left.select(*at, _linear(left, left_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(*keys, *payload).alias("__row"))
    other = known.select(*at, _linear(right, right_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), hit.alias("__hit"))
    low, high = own.select("__t").unionByName(other.select("__t")).agg(F.min("__t"), F.max("__t")).first()
    width = (high - low) / cells if low is not None and high > low else 1.0
    stacked = own.unionByName(other, allowMissingColumns=True).withColumn("__cell", F.floor((F.col("__t") - F.lit(low or 0.0)) / F.lit(width)).cast("int"))

    seen = lambda w: F.last("__hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    latest_first = [F.col("__t").desc(), F.col("__side").desc(), F.col("__hit").desc()]
    here = stacked.withColumn("__found", seen(Window.partitionBy(*names, "__cell").orderBy(*latest_first))).where("__row IS NOT NULL")
    firsts = stacked.groupBy(*names, "__cell").agg(F.min("__hit").alias("__hit"))
    later = firsts.select(*names, "__cell", seen(Window.partitionBy(*names).orderBy(F.col("__cell").desc())).alias("__later"))
    found = here.drop("__hit").join(later.where("__later IS NOT NULL"), [*names, "__cell"], "left").withColumn("__found", F.coalesce("__found", "__later"))
    if within:
        start = F.col(f"__row.`{left_time}`")
        found = found.withColumn("__found", F.when(F.col("__found.time") <= start + F.expr(within), F.col("__found")))
    return found.select("__row.*", F.col("__found.time").alias("next_time"), F.col("__found.value").alias("next_value"))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` whose value lies in a range, by an equi-join on cells of ``width``; long ranges take one row for each cell."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    cut = ranges.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(value)).join(cut, "__cell").where(F.col(value).between(F.col(low), F.col(high))).drop("__cell")


def diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, fields): missing and extra rows, and those whose other fields differ, with the names of the fields."""
    rest = [c for c in expected.columns if c not in keys]
    a = expected.select(*keys, F.struct(*rest).alias("__a"))
    b = actual.select(*keys, F.struct(*rest).alias("__b"))
    fields = F.filter(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in rest]), lambda c: c.isNotNull())
    joined = a.join(b, keys, "full_outer").withColumn("fields", F.concat_ws(",", fields))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("fields") != "", "changed")
    return joined.withColumn("status", status).where("status IS NOT NULL").select(*keys, "status", F.when(F.col("status") == "changed", F.col("fields")).alias("fields"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at rank ceil(p n) of an array (p in 0 to 1); null of an empty one."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = F.greatest(F.least(F.ceil(F.lit(p) * F.size(ordered)), F.size(ordered)), F.lit(1)).cast("int")
    return F.when(F.size(ordered) > 0, F.element_at(ordered, at))


def fan_in(parts: dict[str, tuple[DataFrame, list[Column], int]], key: str) -> DataFrame:
    """(key, one array of rows for each part): the first rows of each part by its order, at most so many, in one record for each key of any part.

    ``parts`` has for each name a frame with the key, its order, and how many rows a record takes; a part's rows are its other columns.
    """
    sides = []
    for name, (frame, order, most) in parts.items():
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        rest = [c for c in frame.columns if c != key]
        few = frame.select(key, F.struct(*rest).alias("__row"), place.alias("__place")).where(F.col("__place") <= most)
        rows = F.transform(F.array_sort(F.collect_list(F.struct("__place", "__row"))), lambda x: x["__row"])
        sides.append((name, few.groupBy(key).agg(rows.alias(name))))
    whole = reduce(lambda a, b: a.join(b, key, "full_outer"), [s for _, s in sides])
    return whole.select(key, *[F.coalesce(F.col(n), F.array().cast(whole.schema[n].dataType)).alias(n) for n, _ in sides])


def outdated_files(files: DataFrame, name: str, main: str, siblings: list[tuple[str, str]], keep: int) -> DataFrame:
    """The rows of ``files`` to delete so that the ``keep`` newest groups stay: main files match the pattern ``main`` and sort by name; ``siblings`` are
    (pattern, replacement) pairs that give a main file's name from a sibling's. Files of no group stay, also siblings without a main file."""
    owner = F.col(name)
    for pattern, replacement in reversed(siblings):
        owner = F.when(F.col(name).rlike(pattern), F.regexp_replace(name, pattern, replacement)).otherwise(owner)
    is_main = F.col(name).rlike(main) & (owner == F.col(name))
    mains = files.where(is_main).select(F.col(name).alias("__main")).distinct()
    kept = mains.orderBy(F.desc("__main")).limit(keep)
    old = mains.join(kept, "__main", "left_anti")
    mark = spare(files, "__owner")
    return files.withColumn(mark, owner).join(old, F.col(mark) == F.col("__main"), "left_semi").drop(mark)


def variant_or_self(rows: DataFrame, variants: DataFrame, item: str, kind: str) -> DataFrame:
    """``rows`` with ``variant``: the variant of the row's item for its kind, the item itself where there is none.

    variants: (family, kind, item), one item for each family and kind; an item is found in whichever kind it stands. One with a single variant maps to itself.
    """
    family = variants.select(F.col("item").alias("__item"), F.col("family").alias("__family")).distinct()
    other = variants.select(F.col("family").alias("__family"), F.col("kind").alias("__kind"), F.col("item").alias("__variant"))
    joined = rows.join(family, F.col(item) == F.col("__item"), "left")
    found = joined.alias("r").join(other.alias("v"), (F.col("r.__family") == F.col("v.__family")) & (F.col(f"r.{kind}") == F.col("v.__kind")), "left")
    return found.select(*[F.col(f"r.{c}") for c in rows.columns], F.coalesce("v.__variant", F.col(f"r.{item}")).alias("variant"))
