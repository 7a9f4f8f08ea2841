"""Guides in Markdown: front matter, sections with their path of headings, and chunks that can be quoted alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a chunk aims at, and below which a part joins its neighbour.
TARGET, SHORT = 900, 250
_HEADING = re.compile(r"(#{1,6})\s+(.*)$")
_ASKED = re.compile(r"\s*<!--\s*(?:preguntas|questions|perguntas)\s*:\s*(.*?)\s*-->\s*$", re.I)
_NEEDED, _LANGUAGES = ("title", "lang", "sources"), ("es", "en", "pt")


def front_matter(text: Column) -> Column:
    """struct(meta, body, problem) of a guide's text: a map of the lines between its first two rules, the text after them, and what is wrong with it (null: nothing)."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    head, body = (F.regexp_extract(plain, r"(?s)\A---\n(.*?)\n---\n(.*)\z", i) for i in (1, 2))
    there = plain.rlike(r"(?s)\A---\n(.*?)\n---\n")
    lines = F.filter(F.split(head, "\n"), lambda line: F.locate(":", line) > 1)
    keys = F.transform(lines, lambda line: F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
    values = F.transform(lines, lambda line: F.trim(F.substring(line, F.locate(":", line) + 1, F.length(line))))
    twice = F.size(F.array_distinct(keys)) < F.size(keys)
    meta = F.when(there & ~twice, F.map_from_arrays(keys, values))
    value = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit(""))
    lacks = F.filter(F.array(*[F.when(value(k) == "", k) for k in _NEEDED]), lambda k: k.isNotNull())
    date = value("verified")
    problem = (
        F.when(~there, "no front matter")
        .when(twice, "a key stands twice")
        .when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", ")))
        .when(~value("lang").isin(*_LANGUAGES), "unknown language")
        .when((value("region") != "") & ~value("region").rlike("^[A-Z]{2}$"), "region is no country code")
        .when((date != "") & ~(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & date.try_cast("date").isNotNull()), "verified is no date")
        .when((value("id") != "") & ~value("id").rlike("^[a-z0-9][a-z0-9-]*$"), "id has other signs than small letters, digits and dashes")
        .when(~body.rlike(r"(?m)^(?!\s*$|#{1,6}\s|\s*<!--\s*(?i:preguntas|questions|perguntas)\s*:)"), "no text")
    )
    return F.struct(meta.alias("meta"), body.alias("body"), problem.alias("problem"))


def _questions(text: str) -> list[str]:
    return [q.strip() for q in text.split("|") if q.strip()]


def sections(body: str) -> list[tuple[list[str], str, list[str]]]:
    """(path, text, questions) of each part with text: the headings above it, outermost first, and what comments say that it answers."""
    parts, above, lines, asked = [], [], [], []
    for line in [*body.split("\n"), None]:
        heading = _HEADING.match(line) if line is not None else None
        if heading or line is None:
            if text := "\n".join(lines).strip():
                parts.append(([name for _, name in above], text, asked))
            if heading:
                depth = len(heading[1])
                above = [*(a for a in above if a[0] < depth), (depth, heading[2].strip())]
            lines, asked = [], []
        elif comment := _ASKED.match(line):
            asked += _questions(comment[1])
        else:
            lines.append(line)
    return parts


def _packed(text: str, target: int) -> Iterator[str]:
    """A text in pieces of whole lines, each of about ``target`` characters or one longer line."""
    piece, size = [], -1
    for line in text.split("\n"):
        if size > 0 and size + 1 + len(line) > target:
            yield "\n".join(piece)
            piece, size = [], -1
        piece = [line] if size <= 0 else [*piece, line]
        size = len(line) if len(piece) == 1 else size + 1 + len(line)
    yield "\n".join(piece)


def chunks_of(body: str, questions: str = "", target: int = TARGET, short: int = SHORT) -> list[tuple[list[str], str, list[str]]]:
    """(path, text, questions) of a guide's chunks: its sections in pieces of whole lines, each under its heading.

    A piece below ``short`` characters that begins another section joins the chunk before it, if both fit in ``target``; so does
    a short first chunk with the second. A section's questions are its first piece's, the guide's own the first chunk's.
    """
    out: list[tuple[list[str], str, list[str]]] = []
    for path, text, asked in sections(body):
        for i, piece in enumerate(p for p in _packed(text, target) if p.strip()):
            own = (f"{path[-1]}\n" if path else "") + piece
            mine = asked if i == 0 else []
            if out and out[-1][0] != path and len(own.strip()) < short and len(out[-1][1]) + 2 + len(own.strip()) <= target:
                before = out[-1]
                out[-1] = (before[0], f"{before[1]}\n\n{own.strip()}", before[2] + mine)
            else:
                out.append((path, own.strip(), mine))
    if len(out) > 1 and len(out[0][1]) < short and len(out[0][1]) + 2 + len(out[1][1]) <= target:
        (_, first, a), (path, second, b) = out[:2]
        out[:2] = [(path, f"{first}\n\n{second}", a + b)]
    if out and (whole := _questions(questions)):
        out[0] = (*out[0][:2], whole + out[0][2])
    return out


def guide_chunks(guides: DataFrame, id_col: str, text_col: str, *, target: int = TARGET, short: int = SHORT) -> DataFrame:
    """(id, title, lang, problem, pos, path, body, questions) of the chunks of each guide; one with a problem has one row that says it, without a body.

    Front matter is read by Spark's own functions; a guide's lines are one value, which a task walks once. Null texts have no front matter.
    """
    read = guides.select(F.col(id_col).alias("id"), front_matter(F.col(text_col)).alias("g"))
    value = lambda k: F.try_element_at("g.meta", F.lit(k)).alias(k)
    rows = read.select("id", value("title"), value("lang"), F.col("g.problem").alias("problem"), F.coalesce(F.try_element_at("g.meta", F.lit("questions")), F.lit("")).alias("asked"), "g.body")
    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("body", pa.string()), ("questions", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            columns = [batch.column(at(c)).to_pylist() for c in ("problem", "asked", "body")]
            made = [None if p else [dict(zip(("path", "body", "questions"), c, strict=True)) for c in chunks_of(b, a, target, short)] for p, a, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in ("id", "title", "lang", "problem")], pa.array(made, kind)], ["id", "title", "lang", "problem", "chunks"])

    id_type = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {id_type}, title string, lang string, problem string, chunks array<struct<path:array<string>,body:string,questions:array<string>>>")
    each = made.select("id", "title", "lang", "problem", F.posexplode_outer("chunks").alias("pos", "c"))
    return each.select("id", "title", "lang", "problem", "pos", "c.path", "c.body", "c.questions")
