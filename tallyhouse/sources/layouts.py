"""Tables out of documents: positioned words to lines, segments and columns; HTML tables; lines by pattern; a registry.

Bronze tables are words (doc, page, text, x0, x1, top, bottom), html (doc, html) or text (doc, line_no, line).  A layout
turns one of them into rows of the same shape: doc, name, year, measure, value, note.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTPUT = ["doc", "name", "year", "measure", "value", "note"]
LAYOUTS: dict[str, Callable[..., DataFrame]] = {}


def layout(name: str) -> Callable:
    """Registers a layout under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LAYOUTS:
            raise ValueError(f"layout {name} is registered twice")
        LAYOUTS[name] = f
        return f

    return add


def word_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``words`` with ``line``: words of a page whose tops lie within ``tolerance`` of the word before, from top to bottom."""
    w = Window.partitionBy("doc", "page").orderBy("top", "x0", "text")
    jump = F.coalesce((F.col("top") - F.lag("top").over(w) > tolerance).cast("int"), F.lit(1))
    return words.withColumn("_j", jump).withColumn("line", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_j")


def segments(lined: DataFrame, gap: float = 12.0) -> DataFrame:
    """(doc, page, line, segment, text, x0, x1): words of a line joined until a gap wider than ``gap``."""
    w = Window.partitionBy("doc", "page", "line").orderBy("x0", "x1", "text")
    jump = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap).cast("int"), F.lit(1))
    s = lined.withColumn("_j", jump).withColumn("segment", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda x: x["text"]), " ")
    return s.groupBy("doc", "page", "line", "segment").agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def in_columns(parts: DataFrame, columns: dict[str, float]) -> DataFrame:
    """``parts`` with the name of the nearest column by the middle of the segment; of equally near ones the first."""
    mid = (F.col("x0") + F.col("x1")) / 2
    near = F.array_min(F.array(*[F.struct(F.abs(mid - x).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, x) in enumerate(columns.items())]))
    return parts.withColumn("column", near["n"])


def html_tables(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """(doc, table_no, row_no, col_no, text) of the cells of all tables; nested tables are read as their outer one's text."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), "(&nbsp;|\\s)+", " "))
    find = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?is)<({tag})\b[^>]*>(.*?)</\1>"), F.lit(2))
    t = pages.select(F.col(doc).alias("doc"), F.posexplode(find(F.col(html), "table")).alias("table_no", "t"))
    r = t.select("doc", "table_no", F.posexplode(find(F.col("t"), "tr")).alias("row_no", "r"))
    c = r.select("doc", "table_no", "row_no", F.posexplode(find(F.col("r"), "td|th")).alias("col_no", "c"))
    return c.select("doc", "table_no", "row_no", "col_no", strip(F.col("c")).alias("text"))


def distance_note(c: Column) -> Column:
    """Struct (value, note): a distance in miles; words for everyone offered, no distance used, unknown."""
    t = F.lower(F.trim(c))
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    miles = F.when(t.rlike(r"\bkms?\b|kilomet"), number / 1.609344).when(t.rlike(r"\d\s*m(etres?)?\b(?!i)"), number / 1609.344).otherwise(number)
    note = (
        F.when(t.rlike("all (offered|applicants|preferences)|undersubscribed"), "all offered")
        .when(t.rlike("^(not applicable|n/?a|-)$"), "not applicable")
        .when(number.isNull() & (t != ""), "unread")
    )
    return F.struct(F.when(note.isNull(), F.round(miles, 3)).alias("value"), note.alias("note"))


@layout("html year columns")
def html_year_columns(pages: DataFrame, measure: str = "max_distance") -> DataFrame:
    """A table with a name column and one column a year; the header is the row whose cells hold years."""
    cells = html_tables(pages)
    years = cells.withColumn("year", F.regexp_extract("text", r"\b(20\d\d)\b", 1).try_cast("int")).where("year is not null and length(text) < 24")
    head = years.groupBy("doc", "table_no").agg(F.min("row_no").alias("_h"))
    years = years.join(head, ["doc", "table_no"]).where("row_no = _h").select("doc", "table_no", "col_no", "year", "_h")
    names = cells.where("col_no = 0").select("doc", "table_no", "row_no", F.col("text").alias("name"))
    body = cells.join(years, ["doc", "table_no", "col_no"]).where("row_no > _h").join(names, ["doc", "table_no", "row_no"])
    d = body.withColumn("d", distance_note(F.col("text")))
    return d.select("doc", "name", "year", F.lit(measure).alias("measure"), "d.value", "d.note").where("name <> ''")


@layout("lines by pattern")
def lines_by_pattern(lines: DataFrame, pattern: str, year: int, measure: str = "max_distance") -> DataFrame:
    """Lines that end in a criterion and a distance; ``pattern`` has the groups name and distance (1 and 2).

    Lines that don't match are given with the note ``unmatched`` so that none is lost unseen.
    """
    hit = F.col("line").rlike(pattern)
    d = distance_note(F.regexp_extract("line", pattern, 2))
    rows = lines.where("trim(line) <> ''").withColumn("d", F.when(hit, d))
    return rows.select(
        "doc", F.when(hit, F.trim(F.regexp_extract("line", pattern, 1))).otherwise(F.trim("line")).alias("name"), F.lit(year).alias("year"),
        F.lit(measure).alias("measure"), F.col("d.value").alias("value"), F.when(hit, F.col("d.note")).otherwise("unmatched").alias("note"),
    )


@layout("words in columns")
def words_in_columns(words: DataFrame, columns: dict[str, float], name: str, years: dict[str, int], measure: str = "max_distance") -> DataFrame:
    """Positioned words of a fixed grid: a name column and one column a year."""
    placed = in_columns(segments(word_lines(words)), columns)
    line = placed.groupBy("doc", "page", "line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    names = line.where(F.col("column") == name).select("doc", "page", "line", F.col("text").alias("name"))
    pick = F.coalesce(*[F.when(F.col("column") == c, F.lit(y)) for c, y in years.items()])
    d = line.withColumn("year", pick).where("year is not null").join(names, ["doc", "page", "line"]).withColumn("d", distance_note(F.col("text")))
    return d.select("doc", "name", "year", F.lit(measure).alias("measure"), "d.value", "d.note")
