"""Acronyms that texts declare, and the votes of a corpus on what they stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as tx

#: Fixed values of the acronym rules: what an acronym is made of, words that open a phrase before its name, and articles.
_UPPER, _LETTER = "A-ZÁÉÍÓÚÑ", "A-Za-zÁÉÍÓÚÑÜáéíóúñü"
ACRONYM = f"[{_UPPER}][{_UPPER}0-9-]{{1,5}}"
OPENERS = (
    "empieza empiecen comienza comiencen es son era llama llaman llamen usa usan use uses busca busque busquen buscar pide pidan pedir trae traigan consigue encuentra "
    "aplica apliquen realiza realicen haz hagan ponte pongan sigue sigan called named que si no y o pero and or to find bring get call ask send another someone go otra otro alguien"
).split()
ARTICLES = "el la los las un una unos unas the a an".split()
ROMAN = "I II III IV V VI VII VIII IX X".split()
REFERENCES = "ver|see|véase|ver guía|ver la|capítulo|chapter"
BEFORE = rf"([{_LETTER}][{_LETTER}-]*(?:\s+[{_LETTER}][{_LETTER}-]*){{0,5}})\s*\(({ACRONYM})\)"
#: What BEFORE finds, in a text that is turned round: from a bracket at most six words on, so that no letter is looked at for each place before it.
TURNED = rf"\)[{_UPPER}0-9-]{{1,5}}[{_UPPER}]\(\s*[{_LETTER}-]*[{_LETTER}](?:\s+[{_LETTER}-]*[{_LETTER}]){{0,5}}"
AFTER = rf"(?:^|[\s(>])({ACRONYM})\s*\(([^)]{{3,70}})\)"
SOUND = f"^[{_LETTER}][{_LETTER} ,-]*$"


def acronym_pairs(text: Column) -> Column:
    """array(struct(acronym, definition)): what a text says its acronyms stand for, each pair (ignoring case and accents) once.

    'definition (ABC)': up to six words before the bracket, without the verbs, links and articles that open them; 'ABC (two
    words or more)'. A definition has 3 to 70 letters, spaces, commas and hyphens, and is no reference; Roman numbers are no acronyms.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", " ")
    split = lambda acronym, words: F.struct(acronym.alias("acronym"), F.split(F.trim(F.regexp_replace(words, r"\s+", " ")), " ").alias("words"))
    opens = lambda w: tx.fold(w).isin(*OPENERS, *ARTICLES)

    def named(p: Column) -> Column:
        first = F.array_position(F.transform(p["words"], opens), False).cast("int")
        at = F.when(first == 0, F.size(p["words"])).otherwise(first)
        return F.struct(p["acronym"].alias("acronym"), F.array_join(F.slice(p["words"], at, F.size(p["words"])), " ").alias("definition"))

    def sound(p: Column) -> Column:
        d = p["definition"]
        fit = F.length(d).between(3, 70) & d.rlike(SOUND) & ~d.rlike(rf"(?i)^({REFERENCES})\b")
        return fit & (F.contains(d, F.lit(" ")) | (F.length(d) >= 4)) & ~p["acronym"].isin(*ROMAN)

    whole = lambda p: F.struct(p["acronym"].alias("acronym"), F.array_join(p["words"], " ").alias("definition"))
    ahead = lambda m: split(F.regexp_replace(F.substring_index(m, "(", -1), r"\)$", ""), F.substring_index(m, "(", 1))
    behind = lambda m: split(F.regexp_extract(m, AFTER, 1), F.regexp_extract(m, AFTER, 2))

    def found(body: Column) -> Column:
        turned = F.reverse(F.regexp_extract_all(F.reverse(body), F.lit(TURNED), F.lit(0)))
        before = F.transform(F.transform(turned, lambda m: ahead(F.reverse(m))), named)
        after = F.transform(F.filter(F.transform(F.regexp_extract_all(body, F.lit(AFTER), F.lit(0)), behind), lambda p: F.size(p["words"]) >= 2), whole)
        return F.filter(F.concat(before, after), sound)

    def once(pairs: Column) -> Column:
        keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["acronym"].alias("a"), tx.fold(p["definition"]).alias("d"), i.alias("i"), p["definition"].alias("definition"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["d"] == y["d"])
        first = lambda ps: F.filter(ps, lambda p, i: (i == 0) | ~same(p, F.get(ps, F.greatest(i - 1, F.lit(0)))))
        back = F.array_sort(F.transform(_bound(keyed, first), lambda p: F.struct(p["i"].alias("i"), p["a"].alias("acronym"), p["definition"].alias("definition"))))
        return F.transform(back, lambda p: F.struct(p["acronym"].alias("acronym"), p["definition"].alias("definition")))

    return once(_bound(body, found))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value (its result is an array) that is worked out once, however often ``use`` names it."""
    return F.flatten(F.transform(F.array(value), use))


def spells(acronym: Column, definition: Column) -> Column:
    """Whether the initials of the definition's words spell the acronym: those of all, or of those that are no links and articles."""
    words = F.filter(F.split(tx.fold(definition), r"[ ,-]+"), lambda w: w != "")
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    short = [*ARTICLES, "de", "del", "of", "y", "e", "and", "para", "for", "in", "en", "da", "do"]
    wanted = F.regexp_replace(tx.fold(acronym), "[^a-z]", "")
    return (initials(words) == wanted) | (initials(F.filter(words, lambda w: ~w.isin(*short))) == wanted)


def mined_acronyms(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(acronym, definition, n_texts, example, spelled, rank): each pair with the texts that declare it, the first of them, and its
    place among its acronym's definitions: by texts, then those whose initials spell it, then alphabetically. Definitions that differ in case and accents are one, written as in the first text."""
    each = texts.select(F.col(id_col).alias("id"), F.explode(acronym_pairs(F.col(text_col))).alias("p")).select("id", "p.*")
    counted = each.groupBy("acronym", tx.fold(F.col("definition")).alias("folded")).agg(F.countDistinct("id").alias("n_texts"), F.min("id").alias("example"), F.min_by("definition", F.struct("id", "definition")).alias("definition"))
    marked = counted.withColumn("spelled", spells(F.col("acronym"), F.col("folded")))
    rank = F.row_number().over(Window.partitionBy("acronym").orderBy(F.desc("n_texts"), F.desc("spelled"), "folded"))
    return marked.select("acronym", "definition", "n_texts", "example", "spelled", rank.alias("rank"))
