r"""Line dedup as an exact set-similarity join with prefix, positional and length filters.

A line is what stands between \n; its tokens are its distinct lower-cased words. A line goes if an earlier
line (order: doc_id, then line number) has a token set of Jaccard similarity >= percent/100. Lines without
a word stay.

1. Word counts over the whole corpus, kept in a table of 2**RARITY_BITS counters, give the token order:
   rarest first. Any total order keeps the join exact, so words sharing a counter cost only time.
2. Equal token sets are one class; its first line stands for it. Copies therefore cost one row for each task.
3. Each class posts the tokens of its prefix (n - ceil(t n) + 1 rarest). Inside a token's list, sorted by size,
   classes are compared only where sizes and prefix positions still allow the overlap if this is the first
   token they share. A 64-bit parity bitmap bounds the symmetric difference from below. A list keeps the
   classes that meet a candidate, never the pairs.
4. What is kept meets again with a bitmap of 256 bits (64 say little of long lines) and with the earlier tokens
   at which a class was kept: a pair belongs to its first common one alone, so it is looked at once.
5. The lists that are left get the full token sets and verify their pairs in place. They give numbers of links,
   not pairs: a group of near copies costs rows in proportion to its members.

Lists of more than LIST_ROWS postings are cut into blocks and compared block with block.

Words are compared by their hashes: 42 bits in classes, 40 in the sets that verify. A class is known by two independent
sums over its words' hashes, of 64 and 40 bits, and by the size of its set (columns ``cls`` and ``two``).
Nothing is capped or sampled. Rows with a null id take no part and stay as they are; null texts have no
lines; rows that share an id count as the same document and get the same decisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm import bytewords as bw
from evispark.llm.tables import broadcast_if_small, key_filter, may_hold, with_class, written

#: Counters of step 1 (a power of two): 256 KB of levels at the driver, 2 MB of counts in a task, whatever the input.
RARITY_BITS = 18
#: Postings of a list, or of one of its blocks, that a task compares with each other.
LIST_ROWS = 1 << 14
#: Bytes of a word's hash in the sets that verify pairs.
SET_BYTES = 5
#: Where the size of a class's set begins in its second number, which therefore sorts by size.
SIZE_BIT = 40
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
WIDE = ("w0", "w1", "w2", "w3")
_HASH42 = np.uint64((1 << 42) - 1)


def _need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes reach the similarity: ceil(percent (n + m) / (100 + percent))."""
    return -((-percent * (n + m)) // (100 + percent))


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -((-percent * n) // 100) + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for a, b in bw.slices(batch.column(0)):
            h, _ = bw.words(batch.column(0).slice(a, b - a))
            total += np.bincount((h >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    for a in range(0, len(some), 1 << 16):
        at = some[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "cnt"])


def token_sets(column: pa.Array, rarity: np.ndarray):
    """Blocks of lines: (row, line number, set size, first token, tokens); tokens are rarity << 42 | hash, rarest first."""
    data, offsets = bw.text_bytes(column)
    data = bw.LOWER[data]
    start, end, _ = bw.spans(data, offsets)
    h = bw.hash_spans(data, start, end)
    begin, _, row = bw.spans(data, offsets, _NEWLINE)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets)[row]
    line = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(start, np.append(begin, len(data)))))
    token = (rarity[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(42)) | (h & _HASH42)
    ends = np.searchsorted(line, np.arange(0, len(begin) + 65535, 65535))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == b:
            continue
        key = ((line[a:b] - k * 65535).astype(np.uint64) << np.uint64(48)) | token[a:b]
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        at = (key >> np.uint64(48)).astype(np.int64) + k * 65535
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        lines = at[first]
        yield row[lines], number[lines], np.diff(np.append(first, len(at))), first, key & np.uint64((1 << 48) - 1)


def _class_of(tokens: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of a class: a sum of 64 bits; the set's size above a second sum of 40 bits."""
    h = bw.mix64(tokens & _HASH42)
    one, two = np.add.reduceat(h, first), np.add.reduceat(h * (h >> np.uint64(23) | np.uint64(1)), first)
    return one.view(np.int64), ((n.astype(np.uint64) << np.uint64(SIZE_BIT)) | (two >> np.uint64(24))).view(np.int64)


def _fresh(cls: np.ndarray, two: np.ndarray, seen: set[int], most: int = 400_000) -> np.ndarray:
    """Marks the first line of each class that this task has not seen; a full memory only lets repeats through."""
    cls = cls ^ bw.mix64(two.view(np.uint64)).view(np.int64)
    fresh = np.zeros(len(cls), bool)
    fresh[np.unique(cls, return_index=True)[1]] = True
    fresh &= np.fromiter((c not in seen for c in cls.tolist()), bool, len(cls))
    if len(seen) < most:
        seen.update(cls[fresh].tolist())
    return fresh


def _bitmaps(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Parity bitmaps of 256 bits, in four parts; their exclusive or is a bitmap of 64 bits."""
    h = bw.mix64(tokens & _HASH42)
    bit, part = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(3)
    return [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), first) for k in range(len(WIDE))]


def _level(count: int) -> int:
    """The rarity of a counter: 0 (rare) to 63."""
    return min(63, math.floor(2 * math.log2(count + 1)))


def _lines(table, percent: int, common: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, seen = table.value, set()
        for batch in batches:
            for a, b in bw.slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, b - a)
                for row, number, n, first, tokens in token_sets(batch.column(1).slice(a, b - a), rarity):
                    cls, two = _class_of(tokens, first, n)
                    wide = _bitmaps(tokens, first)
                    rare = np.add.reduceat((tokens >> np.uint64(42)) < common, first, dtype=np.int32)
                    p = np.where(_fresh(cls, two, seen), _prefix(n, percent), 0)
                    at = np.repeat(first - np.cumsum(p) + p, p) + np.arange(p.sum())
                    offsets = np.zeros(len(p) + 1, np.int32)
                    np.cumsum(p, out=offsets[1:])
                    prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array((tokens[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                    arrays = [ids.take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(cls), pa.array(two), pa.array(rare), *(pa.array(w.view(np.int64), mask=p == 0) for w in wide), prefix]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "line", "cls", "two", "rare", *WIDE, "prefix"])

    return run


def _pairs_in(token, n, pos, cls, bitmap, percent, two=None):
    """Pairs of rows with one token that pass all filters; rows are sorted by token and n. Yields index arrays.

    A pair is looked for at its first shared token only: there the overlap is at most what either set has from
    that token on. Partners of a row (sizes n to 100 n / percent) follow it, up to a limit that a search finds.
    """
    group = np.cumsum(np.append(False, token[1:] != token[:-1])) << 32
    last = np.searchsorted(group | n, group | (100 * n // percent), side="right")
    rest = np.where(n - pos >= _need(n, n, percent), last - np.arange(len(n)) - 1, 0)
    total = np.cumsum(rest)
    at = 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
        c = rest[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        need = _need(n[i], n[j], percent)
        ok = np.flatnonzero((n[i] - pos[i] >= need) & (n[j] - pos[j] >= need))
        i, j, need = i[ok], j[ok], need[ok]
        ok = (np.bitwise_count(bitmap[i] ^ bitmap[j]) <= n[i] + n[j] - 2 * need) & ((cls[i] != cls[j]) | (False if two is None else two[i] != two[j]))
        yield i[ok], j[ok]
        at = to


def _whole_lists(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows sorted by list, in tables that hold whole lists and about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("list").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held)


def _indexed(column: pa.ChunkedArray):
    """Each row's values (of an array, or SET_BYTES each) as numbers below their count: (numbers, start, size, marks to work with)."""
    lists = column.combine_chunks()
    if pa.types.is_binary(lists.type):
        ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        flat = np.zeros(((ends[-1] - ends[0]) // SET_BYTES, 8), np.uint8)
        flat[:, :SET_BYTES] = np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, SET_BYTES)
        flat, size = flat.view(np.uint64)[:, 0], np.diff(ends).astype(np.int64) // SET_BYTES
    else:
        flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    values, number = np.unique(flat, return_inverse=True)
    return number, np.cumsum(size) - size, size, np.zeros(len(values), bool)


def _overlaps(i: np.ndarray, j: np.ndarray, sets) -> np.ndarray:
    """Sizes of the intersections of rows i[k] and j[k]; i ascends, and works through its partners at once."""
    number, start, size, mark = sets
    out, volume = np.zeros(len(i), np.int64), np.cumsum(size[j]) >> 22
    cuts = np.flatnonzero((i[1:] != i[:-1]) | (volume[1:] != volume[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        if a == b:
            continue
        own = number[start[i[a]] : start[i[a]] + size[i[a]]]
        k = size[j[a:b]]
        ends = np.cumsum(k)
        if len(own) and ends[-1]:
            mark[own] = True
            hits = np.zeros(ends[-1] + 1, np.int64)
            np.cumsum(mark[number[np.repeat(start[j[a:b]] - ends + k, k) + np.arange(ends[-1])]], out=hits[1:])
            out[a:b] = hits[ends] - hits[ends - k]
            mark[own] = False
    return out


def _candidates(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that pass all filters in their list and, where earlier tokens are known, share none of these."""
    key, two, pos, cls, bitmap, block = (rows.column(c).to_numpy() for c in ("list", "two", "pos", "cls", "bitmap", "block"))
    across = (key & 0xFFFF) != ((key >> 16) & 0xFFFF)
    n = two >> SIZE_BIT
    earlier = _indexed(rows.column("earlier")) if "earlier" in rows.column_names else None
    wide = [rows.column(c).to_numpy().view(np.uint64) for c in WIDE if c in rows.column_names]
    for i, j in _pairs_in(key, n, pos.astype(np.int64), cls, bitmap.view(np.uint64), percent, two):
        ok = ~across[i] | (block[i] != block[j])
        i, j = i[ok], j[ok]
        if wide:
            apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in wide)
            ok = apart <= n[i] + n[j] - 2 * _need(n[i], n[j], percent)
            i, j = i[ok], j[ok]
        if earlier is not None and len(i):
            ok = _overlaps(i, j, earlier) == 0
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j


def _met(percent: int):
    """The rows that have a candidate in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches):
            met = np.zeros(rows.num_rows, bool)
            for i, j in _candidates(rows, percent):
                met[i] = met[j] = True
            yield from rows.drop_columns([c for c in WIDE if c in rows.column_names]).filter(pa.array(met)).to_batches()

    return run


def _links(percent: int):
    """The number of verified links to earlier classes, for each list and class that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_lists(batches):
            sets, links = _indexed(rows.column("tokens")), np.zeros(rows.num_rows, np.int64)
            n, doc, line = sets[2], rows.column("id").to_numpy(), rows.column("line").to_numpy()
            for i, j in _candidates(rows, percent):
                shared = _overlaps(i, j, sets)
                ok = 100 * shared >= percent * (n[i] + n[j] - shared)
                i, j = i[ok], j[ok]
                later = np.where((doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j])), i, j)
                links += np.bincount(later, minlength=len(links))
            some = np.flatnonzero(links)
            of = [rows.column(c).combine_chunks().take(pa.array(some)) for c in ("cls", "two")]
            yield pa.RecordBatch.from_arrays([*of, pa.array(links[some])], ["cls", "two", "links"])

    return run


def _tokens_of(table, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in bw.slices(batch.column(0), 1 << 20):
                for _, _, n, first, tokens in token_sets(batch.column(0).slice(a, b - a), table.value):
                    cls, two = _class_of(tokens, first, n)
                    keep = may_hold(held.value, cls) & _fresh(cls, two, seen)
                    cls, two, n, first = cls[keep], two[keep], n[keep], first[keep]
                    offsets = np.zeros(len(n) + 1, np.int32)
                    np.cumsum(n, out=offsets[1:])
                    at = np.repeat(first - offsets[:-1], n) + np.arange(n.sum())
                    flat = np.ascontiguousarray(tokens[at].view(np.uint8).reshape(-1, 8)[:, :SET_BYTES])
                    sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets * np.int32(SET_BYTES)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(two), sets], ["cls", "two", "tokens"])

    return run


def rarity_table(texts: DataFrame) -> np.ndarray:
    """Rarity, 0 (rare) to 63, for each of 2**RARITY_BITS counters: a fixed size, whatever the corpus."""
    counts = texts.select("text").mapInArrow(_counts, "bucket int, cnt long").groupBy("bucket").agg(F.sum("cnt").alias("cnt"))
    levels = counts.select("bucket", F.least(F.floor(2 * F.log2(F.col("cnt") + 1)), F.lit(63)).cast("tinyint").alias("level")).toArrow()
    out = np.zeros(1 << RARITY_BITS, np.uint8)
    out[levels.column("bucket").to_numpy()] = levels.column("level").to_numpy()
    return out


def _in_lists(lines: DataFrame) -> DataFrame:
    """(cls, two, bitmap, pos, list, block): list is the token and two numbers of blocks, 0 unless the token's list is long.

    A posting of a long list goes to every pair of blocks that has its own. Only words that the corpus has more
    than LIST_ROWS times (from place ``rare`` on) can have one, so only their postings are counted.
    """
    bitmap = F.col("w0").bitwiseXOR(F.col("w1")).bitwiseXOR(F.col("w2")).bitwiseXOR(F.col("w3"))
    posted = lines.where(F.size("prefix") > 0).select("cls", "two", bitmap.alias("bitmap"), "rare", F.posexplode("prefix").alias("pos", "token"))
    common = lines.where(F.size("prefix") > F.col("rare")).select(F.explode(F.expr("slice(prefix, rare + 1, size(prefix))")).alias("token"))
    counts = common.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > LIST_ROWS)
    longs = written(counts.select("token", F.least(F.ceil(F.col("rows") / LIST_ROWS), F.lit(0xFFFF)).cast("int").alias("blocks")), "long-lists")
    many = longs.count()
    key = F.shiftleft(F.col("token").cast("long"), 32)
    if not many:
        return posted.select("cls", "two", "bitmap", "pos", key.alias("list"), F.lit(0).alias("block"))
    cut = posted.join(broadcast_if_small(longs, many), "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = F.shiftleft(F.least("block", "other").cast("long"), 16).bitwiseOR(F.greatest("block", "other").cast("long"))
    return cut.select("cls", "two", "bitmap", "pos", key.bitwiseOR(both).alias("list"), "block")


def line_decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, removed_lines) for each id that has a line with a word.

    n_links counts, over its lines, the verified links of their classes to earlier classes; removed_lines
    are 0-based positions after splitting the text at \\n.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    table = docs.sparkSession.sparkContext.broadcast(rarity_table(texts))
    words = ", ".join(f"{w} long" for w in WIDE)
    schema = f"id long, line int, cls long, two long, rare int, {words}, prefix array<int>"
    lines = written(texts.mapInArrow(_lines(table, percent, _level(LIST_ROWS)), schema), "lines")
    columns = "cls long, two long, bitmap long, pos int, list long, block int"
    by_list = lambda df: df.repartition("list").sortWithinPartitions("list", "two")
    kept = written(by_list(_in_lists(lines)).mapInArrow(_met(percent), columns), "kept")
    at = F.collect_set(F.struct("pos", "list", "block")).alias("at")
    of_class = kept.groupBy("cls", "two").agg(F.first("bitmap").alias("bitmap"), at)
    wide = lines.where(F.col("w0").isNotNull()).groupBy("cls", "two").agg(*(F.max(w).alias(w) for w in WIDE))
    before = F.transform(F.filter("at", lambda x: x["pos"] < F.col("here.pos")), lambda x: F.shiftright(x["list"], 32).cast("int"))
    again = of_class.join(wide, ["cls", "two"]).withColumn("here", F.explode("at"))
    again = again.select("cls", "two", "bitmap", "here.pos", "here.list", "here.block", *WIDE, before.alias("earlier"))
    kept = written(by_list(again).mapInArrow(_met(percent), f"{columns}, earlier array<int>"), "kept-once")
    first = F.min(F.struct("id", "line")).alias("first")
    classes = written(lines.groupBy("cls", "two").agg(first, F.count("*").alias("copies")), "first-lines")
    # classes are hashes: the scan drops the lines that no list wants, so no text is shuffled
    wanted = key_filter(kept.select("cls").distinct())
    sets = texts.select("text").mapInArrow(_tokens_of(table, wanted), "cls long, two long, tokens binary").dropDuplicates(["cls", "two"])
    full = kept.join(classes.select("cls", "two", "first.id", "first.line"), ["cls", "two"]).join(sets, ["cls", "two"])
    later = by_list(full).mapInArrow(_links(percent), "cls long, two long, links long")
    later = later.groupBy("cls", "two").agg(F.sum("links").alias("links"))
    fates = written(classes.join(later, ["cls", "two"], "left"), "fates")
    placed = with_class(lines.select("id", "line", "cls", "two"), fates, ["cls", "two"], "copies")
    gone = F.col("links").isNotNull() | (F.struct("id", "line") != F.col("first"))
    placed = placed.select("id", "line", F.coalesce("links", F.lit(0)).alias("links"), gone.alias("gone"))
    sets = placed.groupBy(F.col("id").alias("doc_id")).agg(
        F.collect_set("line").alias("all"), F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("out"), F.sum("links").alias("n_links")
    )
    return sets.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.size("out").cast("long").alias("n_removed"), "n_links", F.sort_array("out").alias("removed_lines"))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Each text without the lines at these positions."""
    out = []
    for text, gone in zip(texts, removed, strict=True):
        if not text.is_valid or not gone.is_valid:
            out.append(text.as_py())
            continue
        drop = set(gone.as_py())
        out.append("\n".join(line for at, line in enumerate(text.as_py().split("\n")) if at not in drop))
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` without the later of similar lines; a document of which no line with a word is left goes as a whole.

    Other rows (unchanged ones, empty or null texts, null ids) and all other columns stay as they are.
    """
    fate = line_decisions(docs, id_col=id_col, text_col=text_col, percent=percent).where("n_removed > 0")
    joined = docs.join(fate, docs[id_col].cast("long") == fate["doc_id"], "left").where(~F.coalesce(fate["n_removed"] == fate["n_lines"], F.lit(False)))
    touched = fate["removed_lines"].isNotNull()
    text = docs[text_col].cast("string")
    kept = F.when(touched, _without(F.when(touched, text), fate["removed_lines"])).otherwise(text)
    return joined.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])
