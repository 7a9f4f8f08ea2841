r"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A document leaks an item if a window of the item's length (in words) has a weighted similarity >= percent/100
to the item: over 5-word shingles with multiplicity, sum of w min / sum of w max, where w = ln(1 + N/df) over
the benchmark's N items (a shingle in no item weighs as one in a single item). Words are runs of letters and
digits, lower-cased. An item or window of fewer than five words is one shingle.

1. A window that shares no shingle with the item has similarity 0, so windows start where a shared shingle
   aligns the document with the item, or between two such starts (``filled``). This only prunes, and needs one
   probe of the benchmark's shingles for each document position. A window at a document's end may be shorter.
2. Each window's words give a 64-bit SimHash. Its eight blocks of 8 bits are looked up in an index of
   the items' blocks with up to two bits flipped: by the pigeonhole principle that finds every item of the
   window's length within RADIUS = 23 bits. With equal weights a window of n words at 0.8 has at most n/9 other
   words at an end, and each bit differs with a probability of arccos(8/9)/pi = 0.15 or less: of 380,000 simulated
   pairs at 0.80 to 0.84 one was over 23 bits. If only shingles of little weight differ, up to n/5 words may;
   of 40,000 pairs with 8 of 40 words changed 0.08 % were over it.
3. Survivors within the radius are verified exactly.

Nulls: null texts and null ids give nothing; items without a word are never leaked. Repeated rows give one
result for each (doc_id, item_id). The benchmark is broadcast only if its counted shingles are within a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.tables import broadcast_if_small, written

SHINGLE, PERCENT = 5, 80
#: First bit and width of each block; with RADIUS errors over eight blocks, one block has two at most.
BLOCKS, RADIUS = tuple((8 * k, 8) for k in range(8)), 23


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """Hash of each run of k words; of fewer words, of all of them; of none, an empty array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64 bits, each the majority of that bit over the words' hashes (ties: 0)."""
    zero = F.lit(0).cast("bigint")

    def bit_of(bit: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, bit).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(zero)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda out, bit: out.bitwiseOR(bit_of(bit)))


def _block(fingerprint: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _masks(width: int) -> list[int]:
    """All values of ``width`` bits with at most two ones."""
    return [0, *(1 << i for i in range(width)), *(1 << i | 1 << j for i in range(width) for j in range(i))]


def _by_block(fingerprint: Column, flips: bool) -> Column:
    """An array of (block number, value) of the fingerprint; with ``flips``, of each value within two bits."""
    def entries(k: int, at: int, width: int) -> Column:
        masks = F.array(*[F.lit(m) for m in (_masks(width) if flips else [0])])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), _block(fingerprint, at, width).bitwiseXOR(m).alias("value")))

    parts = [entries(k, at, width) for k, (at, width) in enumerate(BLOCKS)]
    return F.flatten(F.array(*parts))


def filled(windows: Column) -> Column:
    """The windows (n, start) with those between two of the same n that are at most n/4 words apart.

    Where words were put into or taken out of an item, its parts align with different starts, and a window between them
    can be the most similar one; farther apart, too much of the item would lie outside.
    """
    ordered = F.array_sort(windows)

    def between(a: Column, b: Column) -> Column:
        near = (a["n"] == b["n"]) & (b["start"] - a["start"] > 1) & (4 * (b["start"] - a["start"]) <= a["n"])
        inner = F.transform(F.sequence(a["start"] + 1, b["start"] - 1), lambda s: F.struct(a["n"].alias("n"), s.alias("start")))
        return F.when(near, inner)

    gaps = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))), between)
    return F.concat(ordered, F.flatten(F.filter(gaps, lambda g: g.isNotNull())))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, similarity, start, hamming) of the best window of each leaked item in each document."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where("item_id IS NOT NULL AND size(words) > 0").dropDuplicates(["item_id", "words"])
    items = items.select("item_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    items = items.select("item_id", F.size("words").alias("n"), shingles_of(F.col("words"), SHINGLE).alias("sh"), simhash(F.col("hashes")).alias("item_print"))
    items = written(items, "items")
    spread = items.select("item_id", "n", F.posexplode("sh").alias("ipos", "h"))
    df = spread.groupBy("h").agg(F.countDistinct("item_id").alias("df"))
    total, n_shingles = items.select("item_id").distinct().count(), spread.count()
    weight = F.log(1 + F.lit(float(total)) / F.col("df"))
    counted = spread.groupBy("item_id", "n", "h").agg(F.count("*").alias("c")).join(df, "h")
    weights = counted.groupBy("item_id", "n").agg(F.collect_list(F.struct("h", F.col("c").cast("int").alias("c"), weight.alias("w"))).alias("weights"), F.sum(weight * F.col("c")).alias("item_weight"))
    full = written(items.join(weights, ["item_id", "n"]), "weighted-items")
    index = items.select("item_id", "n", "item_print", F.explode(_by_block(F.col("item_print"), True)).alias("b")).select("*", "b.block", "b.value").drop("b")
    rare = F.log(1 + F.lit(float(max(total, 1))))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    # words, hashes and shingles are columns of their own: inside a lambda they would be made anew at each position
    split = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    # items of fewer words are found by runs of their own length, one pass for each such length (four at most)
    lengths = sorted(r.k for r in items.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    runs = [split.select("doc_id", F.lit(k).alias("k"), F.posexplode(shingles_of(F.col("words"), k)).alias("pos", "h")) for k in lengths or [SHINGLE]]
    positions = reduce(DataFrame.unionByName, runs)
    seeds = broadcast_if_small(spread.select("h", F.least("n", F.lit(SHINGLE)).alias("k"), "n", "ipos").distinct(), n_shingles)
    starts = positions.join(seeds, ["h", "k"]).select("doc_id", "n", F.greatest(F.col("pos") - F.col("ipos"), F.lit(0)).alias("start")).distinct()
    starts = written(starts.groupBy("doc_id").agg(filled(F.collect_set(F.struct("n", "start"))).alias("windows")), "windows")

    opened = broadcast_if_small(starts, starts.agg(F.sum(F.size("windows"))).first()[0] or 0).join(texts, "doc_id").select("doc_id", "windows", words_of(F.col("text")).alias("words"))
    window = opened.select("doc_id", F.explode("windows").alias("x"), "words").select("doc_id", "x.n", "x.start", F.slice("words", F.col("x.start") + 1, F.col("x.n")).alias("words"))
    window = window.select("doc_id", "n", "start", shingles_of(F.col("words"), SHINGLE).alias("sh"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    window = written(window.select("doc_id", "n", "start", "sh", simhash(F.col("hashes")).alias("print")), "fingerprints")
    probes = window.select("*", F.explode(_by_block(F.col("print"), False)).alias("b")).select("doc_id", "n", "start", "print", "sh", "b.block", "b.value")
    near = probes.join(broadcast_if_small(index, total * sum(len(_masks(width)) for _, width in BLOCKS)), ["n", "block", "value"])
    near = near.withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where(F.col("hamming") <= RADIUS)
    # an item found by several blocks is verified once: at the first block that its index entries share with the window
    first = F.lit(None).cast("int")
    for k, (at, width) in reversed(list(enumerate(BLOCKS))):
        first = F.when(F.bit_count(_block(F.col("print").bitwiseXOR(F.col("item_print")), at, width)) <= 2, F.lit(k)).otherwise(first)
    near = near.where(F.col("block") == first)
    near = near.join(broadcast_if_small(full.select("item_id", "n", "item_print", "weights", "item_weight"), n_shingles), ["item_id", "n", "item_print"])
    count = lambda h: F.size(F.filter("sh", lambda x: x == h))
    overlap = F.aggregate("weights", F.lit(0.0), lambda a, s: a + s["w"] * F.least(count(s["h"]), s["c"]))
    known = F.aggregate("weights", F.lit(0.0), lambda a, s: a + s["w"] * count(s["h"]))
    strange = F.size(F.filter("sh", lambda x: ~F.exists("weights", lambda s: s["h"] == x)))
    scored = near.select("doc_id", "item_id", "start", "hamming", overlap.alias("overlap"), "item_weight", known.alias("known"), strange.alias("strange"))
    scored = scored.withColumn("similarity", F.col("overlap") / (F.col("item_weight") + F.col("known") + F.col("strange") * rare - F.col("overlap")))
    best = scored.where(F.col("similarity") >= percent / 100 - 1e-12).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), -F.col("hamming"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("start"), (-F.col("b.col3")).alias("hamming"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose id leaks an item; rows with a null id stay."""
    gone = leaks(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, percent=percent).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
