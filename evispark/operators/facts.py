"""A person's facts: what comes in again is merged, a correction replaces, the rest is added.

``absorb`` is a fold over a person's facts in order of arrival (``stateful.fold``): a person is one sorted run, whose facts are
the state. A fact that comes in meets the stored ones, the one changed last first:

1. words: the same words, one text within the other, or a Jaccard similarity of words of NEAR or more: merged;
2. else the attribute (if it has one): of an attribute that may have several values, or with a value that fits (one's words
   among the other's): merged; with another value of a single-valued attribute: replaced;
3. else it is added.

What is merged keeps the longer text if one lies within the other, else the new one. Facts of other persons are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as tx
from evispark.operators.stateful import fold, micros

NEAR = 0.75
_ENYE = ""


def fact_words(content: Column) -> Column:
    """The text as its words for comparison: lower case, signs as spaces, without accents but that of n, one space between."""
    plain = F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}\s]", " ")
    folded = F.replace(tx.fold(F.replace(plain, F.lit("ñ"), F.lit(_ENYE))), F.lit(_ENYE), F.lit("ñ"))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def _near(a: str, b: str) -> bool:
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) >= NEAR * len(x | y)


def _fits(a: str, b: str) -> bool:
    x, y = set(a.split()), set(b.split())
    return x <= y or y <= x if x and y else a == b


def absorb(facts: DataFrame, person: str, time: str, id_col: str, content: str, *, attribute: str | None = None, value: str | None = None, single: str | None = None, stored: str | None = None) -> DataFrame:
    """(person, id, outcome, fact, content) of each row: stored, added, merged or replaced; the fact that it is now part of, and that fact's text after it.

    attribute, value and single (whether it has one value only) are optional columns, as is ``stored``: rows that were
    facts already; they come first and meet nothing. Null contents are empty: they are added.
    """
    none = F.lit(None).cast("string")
    words = fact_words(F.coalesce(F.col(content), F.lit("")))
    inputs = [
        F.col(id_col).cast("long"), F.coalesce(F.col(content), F.lit("")), words,
        F.col(attribute).cast("string") if attribute else none, fact_words(F.col(value)) if value else words,
        F.col(single) if single else F.lit(False), F.col(stored) if stored else F.lit(False),
    ]

    def step(known, i, text, words, attr, val, one, old):
        hit = None if old else next((f for f in known if _near(words, f[2])), None)
        outcome = "stored" if old else "merged" if hit else "added"
        if hit is None and not old and attr is not None:
            same = [f for f in known if f[3] == attr]
            hit = next((f for f in same if not one or _fits(val or "", f[4] or "")), None)
            outcome = "merged" if hit else "replaced" if same else "added"
            hit = hit or (same[0] if same else None)
        made = (i, text, words, attr, val)
        if hit:
            keeps = outcome == "merged" and words in hit[2]
            made = hit if keeps else (hit[0], *made[1:])
            known = [f for f in known if f is not hit]
        return [made, *known], (outcome, made[0], made[1])

    ordered = facts.withColumn("__old", ~(F.col(stored) if stored else F.lit(False)))
    return fold(ordered, [person], ["__old", time, id_col], inputs, [person, id_col], "outcome string, fact long, content string", list, step)


def facts_after(log: DataFrame, events: DataFrame, person: str, time: str, id_col: str) -> DataFrame:
    """(person, fact, content, changes): the facts that are left after ``absorb``'s log of these events."""
    at = F.struct(micros(time).alias("t"), F.col(id_col))
    dated = log.join(events.select(id_col, at.alias("__at")), id_col)
    last = dated.groupBy(person, "fact").agg(F.max_by("content", F.struct(F.col("outcome") != "stored", "__at")).alias("content"), (F.count("*") - 1).alias("changes"))
    return last.select(person, "fact", "content", "changes")
