"""Workbooks, delimited files with preambles, GeoJSON and embedded JSON as DataFrames.

Files are read whole by ``binaryFile`` (one task a file), parsed with the standard library inside the task, and come out as
typed cells; a header is found by a marker cell.  Damaged files give what comes before the damage and a row in the rejects.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row_no int, col_no int, kind string, text string"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """(sheet, row, column, kind, text) of every filled cell; kind is number, text, boolean or error."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.parse(z.open("xl/sharedStrings.xml")).getroot().iter(_MAIN + "si"):
                shared.append("".join(t.text or "" for t in si.iter(_MAIN + "t")))
        rels = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for s in ET.parse(z.open("xl/workbook.xml")).getroot().iter(_MAIN + "sheet"):
            target = rels[s.get(_REL)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            row_no = -1
            held = None
            for event, row in ET.iterparse(z.open(target), ("start", "end")):
                if event == "start" and row.tag == _MAIN + "sheetData":
                    held = row
                if event == "start" or row.tag != _MAIN + "row":
                    continue
                row_no = int(row.get("r", row_no + 2)) - 1
                col = -1
                for c in row.iter(_MAIN + "c"):
                    col = _column(c.get("r")) if c.get("r") else col + 1
                    kind, v = c.get("t", "n"), c.find(_MAIN + "v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if kind == "s" else v.text
                    name = {"s": "text", "str": "text", "inlineStr": "text", "b": "boolean", "e": "error"}.get(kind, "number")
                    yield s.get("name"), row_no, col, name, text
                if held is not None:
                    held.clear()  # rows read stay nowhere


def ods_cells(data: bytes) -> Iterator[tuple[str, int, int, str, str]]:
    """As ``xlsx_cells``; repeated cells and rows are written out, trailing empty ones aside."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for table in ET.parse(z.open("content.xml")).getroot().iter(_TABLE + "table"):
            row_no = 0
            for row in table.iter(_TABLE + "table-row"):
                again = int(row.get(_TABLE + "number-rows-repeated", 1))
                filled, col = [], 0
                for c in row:
                    if c.tag not in (_TABLE + "table-cell", _TABLE + "covered-table-cell"):
                        continue
                    n = int(c.get(_TABLE + "number-columns-repeated", 1))
                    kind = c.get(_OFFICE + "value-type")
                    text = c.get(_OFFICE + "value") or "\n".join("".join(p.itertext()) for p in c.iter(_TEXT + "p"))
                    if kind or text:
                        what = {"float": "number", "currency": "number", "percentage": "number", "boolean": "boolean"}.get(kind, "text")
                        filled += [(col + i, what, text) for i in range(n)]
                    col += n
                for i in range(again if filled else 0):
                    for at, what, text in filled:
                        yield table.get(_TABLE + "name"), row_no + i, at, what, text
                row_no += again


def workbook_cells(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) of .xlsx and .ods files: every filled cell with its place, and the files that can't be read."""
    files = spark.read.format("binaryFile").load(paths)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                made = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")]).astype({"row_no": "Int32", "col_no": "Int32"})
                rows: list[tuple] = []
                try:
                    for c in (ods_cells if path.lower().endswith(".ods") else xlsx_cells)(bytes(data)):
                        rows.append((path, *c))
                        if len(rows) > 50_000:
                            yield made(rows)
                            rows = []
                except Exception as e:  # noqa: BLE001 - any damage makes a reject; cells before it stay
                    rows.append((path, None, None, None, "reject", str(e)[:200]))
                yield made(rows)

    # One file a partition row: files are few and large, and each is parsed once.
    every = files.select("path", "content").mapInPandas(run, CELLS)
    return every.where("kind <> 'reject'"), every.where("kind = 'reject'").select("path", F.col("text").alias("reason"))


def sheet_rows(cell_rows: DataFrame, marker: str, within: int = 15) -> DataFrame:
    """(path, sheet, row_no, values: map header -> text) below the first of ``within`` rows that holds the marker cell.

    Headers are trimmed; a header that comes twice keeps its first column; cells without a header are left out.
    """
    t = F.trim(F.regexp_replace("text", "\\s+", " "))
    head = cell_rows.where((F.col("row_no") < within) & (F.lower(t) == marker.lower())).groupBy("path", "sheet").agg(F.min("row_no").alias("_h"))
    at = cell_rows.join(head, ["path", "sheet"])
    names = at.where("row_no = _h").select("path", "sheet", "col_no", t.alias("header"))
    first = names.groupBy("path", "sheet", "header").agg(F.min("col_no").alias("col_no"))
    body = at.where("row_no > _h").join(first, ["path", "sheet", "col_no"])
    return body.groupBy("path", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("header", "text"))).alias("values"))


def _decoded(data: bytes, encoding: str | None) -> str:
    """Text by the named encoding, else by a byte order mark, else UTF-8 if the whole file is valid, else Windows-1252."""
    if encoding:
        return data.decode(encoding)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def csv_files(spark: SparkSession, paths: str | list[str], marker: str, columns: list[str], encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited files, each read by its own header: the first line with the cell ``marker``.

    rows: path, row_no (of the file, from 0) and the named columns as text; headers are compared trimmed, without case; short
    rows are filled with nulls, blank rows left out.  rejects: path, row_no, reason, for files without the header or a column
    (whose rows are kept with nulls), files that can't be decoded, and rows longer than the header.  One task reads a file.
    """
    files = spark.read.format("binaryFile").load(paths)
    out = [c for c in columns]
    schema = "path string, row_no long, reason string, cells array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                rows: list[tuple] = []
                at: list[int | None] | None = None
                width = 0
                try:
                    for i, row in enumerate(csv.reader(io.StringIO(_decoded(bytes(data), encoding), newline=""))):
                        if at is None:
                            head = [c.strip().upper() for c in row]
                            if marker.upper() in head:
                                at = [head.index(c.strip().upper()) if c.strip().upper() in head else None for c in columns]
                                width = len(row)
                                rows += [(path, i, f"no column {c}", None) for c, x in zip(columns, at) if x is None]
                        elif any(c.strip() for c in row):
                            if len(row) > width and any(c.strip() for c in row[width:]):
                                rows.append((path, i, "more cells than headers", row))
                            else:
                                rows.append((path, i, None, [row[x] if x is not None and x < len(row) else None for x in at]))
                        if len(rows) > 50_000:
                            yield pd.DataFrame(rows, columns=["path", "row_no", "reason", "cells"]).astype({"row_no": "Int64"})
                            rows = []
                    if at is None:
                        rows.append((path, None, f"no header with {marker}", None))
                except (UnicodeError, csv.Error) as e:
                    rows.append((path, None, str(e)[:200], None))
                yield pd.DataFrame(rows, columns=["path", "row_no", "reason", "cells"]).astype({"row_no": "Int64"})

    every = files.select("path", "content").mapInPandas(run, schema)
    rows = every.where("reason is null").select("path", "row_no", *[F.col("cells")[i].alias(c) for i, c in enumerate(out)])
    return rows, every.where("reason is not null").select("path", "row_no", "reason")


def csv_after_preamble(spark: SparkSession, path: str, marker: str, encoding: str | None = None) -> DataFrame:
    """Delimited files whose header is the first line with the cell ``marker``; all columns are text, headers upper case.

    The columns are those of the first file by path; every file is read by its own header, so their order may differ.
    """
    first = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, 65_536).alias("c")).first()
    if first is None:
        raise ValueError(f"no file at {path}")
    head = bytes(first.c)
    try:
        text = _decoded(head, encoding)
    except UnicodeDecodeError:
        text = head.decode(encoding or "utf-8", "replace")
    if not encoding and len(head) == 65_536:  # the cut may split a character
        text = head.decode("utf-8-sig", "ignore")
    found = (row for row in csv.reader(io.StringIO(text)) if marker.upper() in [c.strip().upper() for c in row])
    header = [c.strip().upper() for c in next(found, [])]
    if not header:
        raise ValueError(f"no header with {marker} in {path}")
    names = list(dict.fromkeys(h for h in header if h))
    return csv_files(spark, path, marker, names, encoding)[0].select(*[f"`{n}`" for n in names])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; a source without any row is an error; unreadable lines come out with nulls and ``_bad``."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    if rows.select(F.lit(1)).isEmpty():
        raise ValueError(f"no rows at {path}")
    return rows


def json_array(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files that hold one JSON array each, decoded element by element: path, pos, doc (JSON text).

    A file that ends early gives the elements before the break, and a reject.
    """
    files = spark.read.format("binaryFile").load(path)
    schema = "path string, pos long, reason string, doc string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        names = ["path", "pos", "reason", "doc"]
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                text, rows, pos = bytes(data).decode("utf-8-sig", "replace"), [], 0
                skip = re.compile(r"[\s,]*")
                at = skip.match(text).end()
                reason = None if text[at : at + 1] == "[" else "no array"
                at = skip.match(text, at + 1).end()
                while reason is None and text[at : at + 1] != "]":
                    try:
                        _, end = decoder.raw_decode(text, at)
                    except ValueError:
                        reason = "cut off" if at >= len(text.rstrip()) or text.rstrip()[-1] != "]" else "not readable"
                        break
                    rows.append((name, pos, None, text[at:end]))
                    pos, at = pos + 1, skip.match(text, end).end()
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if reason is not None:
                    rows.append((name, pos, reason, None))
                yield pd.DataFrame(rows, columns=names)

    every = files.select("path", "content").mapInPandas(run, schema)
    return every.where("reason is null").select("path", "pos", "doc"), every.where("reason is not null").select("path", "pos", "reason")


def json_by_key(spark: SparkSession, root: str, key: str, schema: str, rows: str) -> DataFrame:
    """Files under ``root``/``key``=value/, each an array of rows or an object that holds them under ``rows``; ``key`` as a column.

    A folder without files gives no rows.
    """
    text = spark.read.option("wholetext", True).option("basePath", root).option("ignoreMissingFiles", True).text(f"{root}/{key}=*")
    doc = F.trim("value")
    shape = f"array<struct<{schema}>>"
    either = F.coalesce(F.when(doc.startswith("["), F.from_json(doc, shape)), F.from_json(doc, f"struct<`{rows}`: {shape}>")[rows])
    return text.select(key, F.explode(either).alias("_r")).select(key, "_r.*")


def with_centroid(areas: DataFrame) -> DataFrame:
    """``areas`` with ``x`` and ``y``: the middle of all rings weighted by area, holes (turned the other way) taken off; where
    they have no area, the mean of the corners."""
    from tallyhouse.operators.joins import ring_centroid

    parts = F.transform("rings", ring_centroid)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.coalesce(p["area"], F.lit(0.0)))
    mean = lambda n: F.try_divide(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.coalesce(p["area"] * p[n], F.lit(0.0))), F.nullif(total, F.lit(0.0)))
    corners = F.flatten("rings")
    plain = lambda n: F.try_divide(F.aggregate(corners, F.lit(0.0), lambda acc, p: acc + p[n]), F.size(corners).cast("double"))
    return areas.withColumn("x", F.coalesce(mean("x"), plain("x"))).withColumn("y", F.coalesce(mean("y"), plain("y")))


def features(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """GeoJSON features: the named properties as text and ``rings`` (polygons and multipolygons as arrays of rings of x, y)."""
    props = ", ".join(f"`{p}`: string" for p in properties)
    schema = f"features array<struct<properties: struct<{props}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    many = F.from_json(c, "array<array<array<array<double>>>>")
    one = F.from_json(c, "array<array<array<double>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)).when(F.col("f.geometry.type") == "Polygon", one)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return f.select(*[F.col(f"f.properties.`{p}`").alias(p) for p in properties], F.transform(rings, lambda r: F.transform(r, point)).alias("rings"))


def page_links(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` with title, links and text of HTML, by expressions only."""
    h = F.col(html)
    title = F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    links = F.array_distinct(F.regexp_extract_all(h, F.lit(r'(?i)<a\b[^>]*?href\s*=\s*["\']([^"\']+)'), F.lit(1)))
    bare = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.withColumn("title", title).withColumn("links", links).withColumn("text", F.trim(F.regexp_replace(bare, r"\s+", " ")))


def near_numbers(text_rows: DataFrame, text: str, word: str, window: int = 120) -> DataFrame:
    """Rows once per number that stands within ``window`` characters after ``word``: ``number``, ``snippet``."""
    hits = F.regexp_extract_all(F.col(text), F.lit(rf"(?is)\b{re.escape(word)}\b(.{{0,{window}}})"), F.lit(1))
    one = text_rows.withColumn("snippet", F.explode(hits))
    return one.withColumn("number", F.explode(F.regexp_extract_all("snippet", F.lit(r"(\d[\d,]*\.?\d*)"), F.lit(1)))).withColumn(
        "number", F.replace("number", F.lit(","), F.lit("")).try_cast("double")
    )
