"""Repair of a conversation's structure: faults of its turns, and the cheapest edits that make its roles alternate.

A sound conversation's role initials match ``(s?(ua)+)?``: at most one system turn, then user and assistant in
turns. ``repair`` flags each turn's first fault in windows, collects a conversation's turns in order, and folds
them in one ``aggregate()``: the fold carries the cheapest (cost, edits) for each of four states (nothing yet,
after the system turn, after a user, after an assistant) and moves on by ``least``, so of equally cheap repairs the
one whose edits come first in ASCII wins. Everything is a Spark SQL expression.

Turns come by turn (nulls first), then role, text. Null roles and texts are one space; a null conversation id is a
conversation of its own; repeated rows are turns of their own (and so duplicates). A conversation is one value of
the result, as its repaired text is: all of it is in one task, and its text must be below Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of the fold's edits, in the order of the audit's letters D < I < K < R: J and S are I and R that make an assistant.
_D, _I_USER, _I_ASSISTANT, _K, _R_USER, _R_ASSISTANT = "DIJKRS"
#: A cost that no repair of a state which can't be reached may win with.
_NEVER = 1 << 50


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the turns with faults put in by crc32 of 'conv_id:turn' modulo 20.

    0 drops the turn (its row stays, not present), 1 empties its text, 2 takes its full stops, exclamation and question
    marks away, 3 repeats it, 4 makes its role user. Nulls are one space, in that key too.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") != 0).alias("present"), again.alias("again"))
    return made.drop("again")


def faults(turns: DataFrame, present: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, here, at, fault, illegal): each turn's place, first fault and whether its role may not
    follow the one before. Turns that aren't present have no fault and count nowhere."""
    here = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), here.alias("here"))
    rows = rows.repartition("conv_id")
    in_order = Window.partitionBy("conv_id", "here").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy("at"))
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    pair = F.concat(F.substring(F.lag("role").over(in_order), 1, 1), F.substring("role", 1, 1))
    illegal = F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))
    placed = rows.withColumns({"at": F.row_number().over(in_order), "illegal": illegal}).withColumn("seen", before > 1)
    fault = F.when(said == "", "blank").when(F.col("seen"), "duplicate").when(~said.isin(".", "!", "?"), "truncated").otherwise("")
    return placed.select("conv_id", "turn", "role", "text", "here", "at", fault.alias("fault"), "illegal")


def _state(cost: Column, edits: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), edits.cast("string").alias("edits"))


def _after(state: Column, cost, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["edits"], F.lit(letter)))


def _states(nothing: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(nothing.alias("nothing"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _with_inserts(s: Column) -> Column:
    """The states when turns may be put in before the next one."""
    user = F.least(s["user"], *[_after(s[k], INSERT, _I_USER) for k in ("nothing", "system", "assistant")])
    both = F.array(_states(s["nothing"], s["system"], user, s["assistant"]))
    return F.transform(both, lambda t: _states(t["nothing"], t["system"], t["user"], F.least(t["assistant"], _after(t["user"], INSERT, _I_ASSISTANT))))[0]


def _next(s: Column, x: Column) -> Column:
    """The states after the turn ``x``; ``s`` has its inserts."""
    stays = ~x["fault"].isin("blank", "duplicate")
    more = F.when(x["fault"] == "truncated", TRUNCATED).otherwise(0)
    first = F.substring(x["role"], 1, 1)
    kept = lambda key, initial: F.when(stays & (first == initial), _after(s[key], more, _K))
    rerole = lambda key, letter: F.when(stays, _after(s[key], more + REROLE, letter))
    gone = lambda key: _after(s[key], DELETE, _D)
    before_user = ("nothing", "system", "assistant")
    return _states(
        gone("nothing"),
        F.least(gone("system"), kept("nothing", "s")),
        F.least(gone("user"), *[kept(k, "u") for k in before_user], *[rerole(k, _R_USER) for k in before_user]),
        F.least(gone("assistant"), kept("user", "a"), rerole("user", _R_ASSISTANT)),
    )


def cheapest(turns: Column) -> Column:
    """struct(cost, edits) of the cheapest repair of an array of turns (role, fault)."""
    never = _state(F.lit(_NEVER), F.lit(""))
    start = _states(_state(F.lit(0), F.lit("")), never, never, never)
    bound = lambda s, f: F.transform(F.array(s), f)[0]  # noqa: E731  (names a value that is used more than once)
    return F.aggregate(turns, start, lambda s, x: bound(_with_inserts(s), lambda t: _next(t, x)), lambda s: bound(_with_inserts(s), lambda t: F.least(t["nothing"], t["assistant"])))


def repaired(turns: Column, edits: Column) -> Column:
    """array(struct(role, text)) of the turns after the edits."""
    made = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    # one part for each turn: what is put in before it, then what is done with it; a last part has what is put in at the end
    parts = F.regexp_extract_all(edits, F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0))

    def done(part: Column, x: Column) -> Column:
        added = F.filter(F.split(F.regexp_replace(part, "[^IJ]", ""), ""), lambda c: c != "")
        put_in = F.transform(added, lambda c: made(F.when(c == _I_USER, "user").otherwise("assistant"), F.lit("")))
        last = F.right(part, F.lit(1))
        role = F.when(last == _K, x["role"]).when(last == _R_USER, "user").otherwise("assistant")
        own = F.when(last.isin(_K, _R_USER, _R_ASSISTANT), F.array(made(role, x["text"]))).otherwise(F.slice(F.array(made(role, x["text"])), 1, 0))
        return F.concat(put_in, own)

    return F.flatten(F.zip_with(parts, turns, done))


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation.

    ``turns`` has conv_id, turn, role and text; with ``present``, a boolean column, turns that aren't present count
    nowhere, but their conversation has its row (zeros, no edits and no turns if none is). audit has the letters of
    the cheapest edits: Keep, Rerole, Delete, Insert; repaired has the turns (role, text) after them.
    """
    flagged = faults(turns, present)
    turn = F.when(F.col("here"), F.struct("at", "turn", "role", "text", "fault"))
    count = lambda f: F.count_if(F.col("here") & (F.col("fault") == f)).alias(f)
    grouped = flagged.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        *[count(f) for f in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("here") & F.col("illegal")).alias("illegal"),
        (F.max(F.when(F.col("here"), F.col("turn"))) - F.min(F.when(F.col("here"), F.col("turn"))) + 1).alias("span"),
    )
    numbers = F.filter(F.array_distinct(F.transform("turns", lambda x: x["turn"])), lambda t: t.isNotNull())
    best = grouped.withColumn("gaps", F.coalesce(F.col("span") - F.size(numbers), F.lit(0)).cast("long")).withColumn("best", cheapest(F.col("turns")))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]
    audit = F.translate("best.edits", _I_ASSISTANT + _R_ASSISTANT, _I_USER + _R_USER)
    return best.select(*names, F.col("best.cost").alias("cost"), audit.alias("audit"), repaired(F.col("turns"), F.col("best.edits")).alias("repaired"))
