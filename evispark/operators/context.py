"""Fitting ranked passages into a budget of tokens: what is left out, what is cut, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a cut passage must keep: so many characters, or this share of the whole.
LEAST_CHARS, LEAST_SHARE = 320, 0.25


def tokens_of(body: Column, chars: int, frame: int) -> Column:
    """Tokens of an entry: its frame (number, title, blank line) and a token for each ``chars`` characters begun."""
    return frame + F.ceil(F.length(body) / chars)


def cut_at_end(body: Column, most: Column) -> Column:
    """The longest start of a text of ``most`` characters or fewer that ends with a sentence or a line; empty if there is none."""
    room = F.substring(body, F.lit(1), most + 1)  # one more: the white space that shows an end
    sentence = F.regexp_extract(room, r"(?s)\A(.*[.!?…][\"»”')\]]*)\s", 1)
    line = F.regexp_replace(F.regexp_extract(room, r"(?s)\A(.*)\n", 1), r"\s+\z", "")
    return F.when(F.length(line) > F.length(sentence), line).otherwise(sentence)


def fit_context(ranked: DataFrame, budget: Column, *, chars: int = 3, frame: int = 8, least_chars: int = LEAST_CHARS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``ranked`` (q, rank, body and what else it has) cut down to what fits, with body as it is served, tokens and truncated.

    Passages go from the end until the rest is within the budget (an expression over ``ranked``, one value for each q). If not even the first fits, it
    is cut at the end of a sentence or line; what is cut keeps at least ``least_chars`` characters or ``least_share`` of the
    passage, else it goes too, and the next one is the first. No q's tokens pass its budget; a q of which nothing fits has no rows. Null bodies are empty.

    A passage's own fate doesn't depend on the others', so the first one that stays is an aggregate over the ranked list, and
    the rest a running sum from it: windows over one q, which has as many rows as its list.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    rows = ranked.withColumn("__budget", budget.cast("long")).withColumn("body", body).withColumn("__whole", tokens_of(F.col("body"), chars, frame))
    room = ((F.col("__budget") - frame) * chars).cast("int")
    short = F.when(room > 0, cut_at_end(F.col("body"), room)).otherwise("")
    useful = (F.length("__short") > 0) & ((F.length("__short") >= least_chars) | (F.length("__short") >= least_share * F.length("body")))
    judged = rows.withColumn("__fits", F.col("__whole") <= F.col("__budget")).withColumn("__short", F.when(~F.col("__fits"), short)).withColumn("__cut", F.coalesce(~F.col("__fits") & useful, F.lit(False)))
    one = Window.partitionBy("q")
    start = F.min(F.when(F.col("__fits") | F.col("__cut"), F.col("rank"))).over(one)
    begun = judged.withColumn("__start", start).where("rank >= __start")
    first_cut = F.max(F.when(F.col("rank") == F.col("__start"), F.col("__cut"))).over(one)
    running = F.sum("__whole").over(one.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = begun.withColumn("truncated", first_cut).withColumn("__running", running)
    kept = kept.where((F.col("truncated") & (F.col("rank") == F.col("__start"))) | (~F.col("truncated") & (F.col("__running") <= F.col("__budget"))))
    served = kept.withColumn("body", F.when(F.col("truncated"), F.col("__short")).otherwise(F.col("body")))
    return served.withColumn("tokens", tokens_of(F.col("body"), chars, frame)).select(*ranked.columns, "tokens", "truncated")
