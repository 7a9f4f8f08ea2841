"""Text files and tables: kinds of files, CSV as text, result logs, and sinks that keep an exact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The brands of HEIF images, and the endings of files that are text.
HEIF_BRANDS = "heic heix hevc hevx heim heis hevm hevs mif1 msf1 avif avis".split()
TEXT_ENDINGS = "txt md markdown csv json html htm log text".split()
#: What marks a result in a log line.
LOG_MARK = "[EVAL] "


def file_kind(name: Column, content: Column) -> Column:
    """pdf, image, text, or unsupported:spreadsheet, archive, old-office or unknown: by the first bytes, then by the name, then by what they look like."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    head = F.hex(F.substring(content, 1, 16))
    at = lambda first, size: F.substring(head, 2 * first + 1, 2 * size)
    is_ = lambda first, text: at(first, len(text)) == text.encode("latin-1").hex().upper()
    image = is_(0, "\xff\xd8\xff") | is_(0, "\x89PNG\r\n\x1a\n") | (is_(0, "RIFF") & is_(8, "WEBP")) | is_(0, "GIF87a") | is_(0, "GIF89a") | (is_(0, "BM") & (ending == "bmp"))
    image |= is_(4, "ftyp") & at(8, 4).isin(*(b.encode().hex().upper() for b in HEIF_BRANDS))
    sample = F.substring(content, 1, 16)
    clean = (F.octet_length(content) > 0) & F.is_valid_utf8(sample) & ~sample.cast("string").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return (
        F.when(is_(0, "%PDF-"), "pdf").when(image, "image")
        .when(is_(0, "PK\x03\x04"), F.when(ending.isin("xlsx", "xlsm", "ods"), "unsupported:spreadsheet").otherwise("unsupported:archive"))
        .when(is_(0, "\xd0\xcf\x11\xe0"), "unsupported:old-office")
        .when(ending.isin(*TEXT_ENDINGS) | clean, "text").otherwise("unsupported:unknown")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind(F.col("path"), F.col("content")).alias("kind"), "length", "content")


def csv_to_text(raw: Column) -> Column:
    """A CSV file as text: no blank lines, fields apart by bars."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda line: F.trim(line) != "")
    return F.array_join(F.transform(lines, lambda line: F.replace(line, F.lit(","), F.lit(" | "))), "\n")


def read_log_rows(spark: SparkSession, path: str, schema: T.StructType, needed: list[str]) -> DataFrame:
    """Rows of result logs: what follows LOG_MARK in a line, or a line that is an object itself; rows that lack one of ``needed`` are dropped."""
    return log_rows(spark.read.text(path), schema, needed)


def log_rows(lines: DataFrame, schema: T.StructType, needed: list[str]) -> DataFrame:
    at = F.instr("value", LOG_MARK + "{")
    json = F.when(at > 0, F.expr(f"substring(value, instr(value, '{LOG_MARK}{{') + {len(LOG_MARK)})")).when(F.trim("value").startswith("{"), F.trim("value"))
    rows = lines.select(F.from_json(json, schema).alias("r")).select("r.*")
    for name in needed:
        rows = rows.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return rows


def csv_cell(value: Column, kind: T.DataType) -> Column:
    """A CSV cell: empty for null, arrays joined by bars, quoted where a comma, a quote or a line end stands in it."""
    text = F.array_join(value, "|") if isinstance(kind, T.ArrayType) else value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n]'), quoted).otherwise(text), F.lit(""))


def csv_line(df: DataFrame) -> Column:
    """A row of ``df`` as a CSV line, its columns in order."""
    cells = [csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return F.concat(*[c if i == 0 else F.concat(F.lit(","), c) for i, c in enumerate(cells)])


def csv_lines(df: DataFrame, order: list[Column], section: int = 0, title: str | None = None) -> DataFrame:
    """(section, n, line): the lines of a CSV table; a ``title`` goes before the header, after an empty line, if the table has rows."""
    body = df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("n"), csv_line(df).alias("line"))
    top = [",".join(df.columns)] if title is None else ["", f"# {title}", ",".join(df.columns)]
    head = df.sparkSession.createDataFrame([(section, i - len(top), line) for i, line in enumerate(top)], "section int, n long, line string")
    if title is not None:
        head = head.join(body.limit(1).select("section"), "section", "left_semi")
    return head.unionByName(body)


def write_csv(df: DataFrame, path: str, *, order: list[Column] | None = None) -> None:
    """CSV files without a header, their cells as ``csv_cell`` makes them; in order over all files if one is given."""
    rows = df.sort(*order) if order else df
    rows.select(csv_line(df).alias("value")).write.option("lineSep", "\n").text(path)


def write_jsonl(df: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON object a line with these columns, in this order; nulls are written."""
    df.select(*columns).write.option("ignoreNullFields", "false").json(path)


def export_collection(chunks: DataFrame, path: str, columns: list[str]) -> None:
    """The distinct rows of a collection as JSON lines."""
    chunks.select(*columns).dropDuplicates().write.option("ignoreNullFields", "false").json(path)
