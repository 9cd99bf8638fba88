"""Queries over the school register, its monthly extracts and the finance workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.clean import fold, loose_date, postcode
from tallyhouse.operators import drift
from tallyhouse.operators.history import attribute_history
from tallyhouse.operators.near import near_members
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.session import staged

C = Catalogue()

def p1_state() -> dict[str, Column]:
    """What makes a version of a school: folded status, close date as a date, former URNs as a set."""
    former = F.array_sort(F.array_distinct(F.array_compact("former_urns")))
    return {
        "status": fold(F.col("status")),
        "close_date": loose_date(F.col("close_date")),
        "former_urns": F.coalesce(former, F.expr("cast(array() as array<bigint>)")),
    }


_P1_RESOLVED = r"""
WITH typed AS (
  SELECT urn, snapshot_date, loaded_at,
    trim(regexp_replace(lower(status), '[\s ]+', ' ', 'g')) AS status,
    CASE WHEN close_date IS NULL OR trim(close_date) = '' THEN NULL
      WHEN regexp_full_match(close_date, '\d{5}') THEN DATE '1899-12-30' + CAST(close_date AS INTEGER)
      ELSE CAST(coalesce(try_strptime(close_date, '%d-%m-%Y'), try_strptime(close_date, '%d/%m/%Y'),
        try_strptime(close_date, '%Y-%m-%d'), try_strptime(close_date, '%d %B %Y')) AS DATE) END AS close_date,
    list_sort(list_distinct(coalesce(former_urns, []))) AS former_urns
  FROM establishment_snapshot WHERE urn IS NOT NULL AND snapshot_date IS NOT NULL),
resolved AS (
  SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY urn, snapshot_date ORDER BY loaded_at DESC NULLS LAST) = 1),
changed AS (
  SELECT *, lag(urn) OVER w AS was, lag(status) OVER w AS s0, lag(close_date) OVER w AS c0, lag(former_urns) OVER w AS f0
  FROM resolved WINDOW w AS (PARTITION BY urn ORDER BY snapshot_date)),
starts AS (
  SELECT * FROM changed WHERE was IS NULL OR status IS DISTINCT FROM s0 OR close_date IS DISTINCT FROM c0
    OR former_urns IS DISTINCT FROM f0)
"""

P1_SQL = (
    _P1_RESOLVED
    + """SELECT urn, strftime(snapshot_date, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(lead(snapshot_date) OVER (PARTITION BY urn ORDER BY snapshot_date), '%Y-%m-%d'), '') AS valid_to
FROM starts"""
)


@C.query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of status, close date and former URNs of every school, with the period each was valid."""
    history = attribute_history(
        table(spark, sf_dir, "establishment_snapshot"), key="urn", snapshot="snapshot_date", loaded="loaded_at", state=p1_state()
    )
    return history.select(
        "urn",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("")).alias("valid_to"),
    )


@C.query(
    "p1_versions",
    _P1_RESOLVED
    + """SELECT urn, snapshot_date AS valid_from, lead(snapshot_date) OVER (PARTITION BY urn ORDER BY snapshot_date) AS valid_to,
  status, close_date, array_to_string(former_urns, ',') AS former_urns FROM starts""",
)
def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions with the state each one holds."""
    history = attribute_history(
        table(spark, sf_dir, "establishment_snapshot"), key="urn", snapshot="snapshot_date", loaded="loaded_at",
        state=p1_state(), keep_state=True,
    )
    return history.withColumn("former_urns", F.array_join(F.col("former_urns").cast("array<string>"), ","))


def school_places(spark: SparkSession, sf_dir: str, box: tuple[float, float, float, float] = (49.0, 61.5, -9.0, 2.5)) -> DataFrame:
    """urn, lat, lon of the register's schools that have a known postcode with a usable position (inside ``box``).

    Of a school's rows the latest with a readable postcode counts, of a postcode's rows the latest introduced.
    """
    est = table(spark, sf_dir, "establishment").select("urn", postcode(F.col("postcode")).alias("pc"), "extracted_at")
    est = est.where("urn is not null and pc is not null").groupBy("urn").agg(F.max_by("pc", F.struct("extracted_at", "pc")).alias("pc"))
    south, north, west, east = box
    points = table(spark, sf_dir, "postcode_point").select(postcode(F.col("pcds")).alias("pc"), "lat", "lon", "introduced")
    points = points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.col("pc").isNotNull())
    points = points.groupBy("pc").agg(F.max(F.struct("introduced", "lat", "lon")).alias("p")).select("pc", "p.lat", "p.lon")
    return est.join(points, "pc").select("urn", "lat", "lon")


P4_SQL = r"""
WITH typed AS (SELECT urn, extracted_at, regexp_replace(upper(postcode), '[^A-Z0-9]', '', 'g') AS t FROM establishment),
pc AS (SELECT urn, extracted_at, left(t, 2) || translate(substr(t, 3, len(t) - 5), 'OILZSB', '011258') || ' '
    || translate(substr(t, len(t) - 2, 1), 'OILZSB', '011258') || right(t, 2) AS pc FROM typed WHERE len(t) BETWEEN 6 AND 7),
est AS (SELECT urn, arg_max(pc, extracted_at) AS pc FROM pc GROUP BY urn),
pts AS (SELECT DISTINCT pcds AS pc, lat, lon FROM postcode_point WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -9 AND 2.5),
spot AS (SELECT urn, lat, lon, CAST(floor(lat / 0.004) AS BIGINT) AS cell FROM est JOIN pts USING (pc)),
wide AS (SELECT urn, lat, lon, unnest([cell - 1, cell, cell + 1]) AS cell FROM spot)
SELECT a.urn AS urn_a, b.urn AS urn_b FROM spot a JOIN wide b ON a.cell = b.cell AND a.urn < b.urn
WHERE abs(a.lon - b.lon) < 0.02 AND 2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 400
"""


@C.query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two schools of the register at most 400 metres apart."""
    pairs = near_members(school_places(spark, sf_dir), 400.0, id_col="urn", one_place=True)  # a row a school
    return pairs.select(F.col("id_a").alias("urn_a"), F.col("id_b").alias("urn_b"))


def return_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all workbooks, written once: record_id, file_name, read_at, copy (a number for each row read), tie (a hash of the payload),
    family (the source), edition (the book's year), entity (the URN), header, parent, kind, text, num; a row without header
    for each record, whose kind says whether its payload could be read."""
    by = {
        "record_id": F.col("record_id"),
        "read_at": F.col("read_at"),
        "copy": F.monotonically_increasing_id(),
        "tie": F.xxhash64("payload"),
        "family": F.upper(F.trim("source")),
        "edition": F.nullif(F.regexp_extract("file_name", r"(\d{4}-\d{2})", 1), F.lit("")),
    }
    return staged(drift.cells(table(spark, sf_dir, "finance_return_raw"), "payload", by, entity="urn", every=True), "cells")


@C.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change in the columns of a workbook against the preceding year's of the same source."""
    return drift.schema_changes(return_cells(spark, sf_dir)).select(
        F.col("family").alias("source"), F.col("edition").alias("book_year"), "change_kind", "old_field", "new_field"
    )


@C.query("p6_returns")
def p6_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all returns: figures and texts of each record under the last name of every column.

    Of a record that comes twice the one read last counts, among those with a readable payload if there are any.  Records
    without cells to show have a row with empty ``lines`` and ``texts``; ``rejected`` says why nothing could be read:
    payload (null, cut off or no object) or file (no source or year).
    """
    cells = return_cells(spark, sf_dir)
    records = cells.where("header is null and record_id is not null")
    order = F.struct(F.col("kind").isNotNull(), F.col("read_at"), F.col("edition"), F.col("family"), F.col("tie"), F.col("copy"))
    last = records.groupBy("record_id").agg(F.max_by(F.struct("copy", "family", "edition", "kind"), order).alias("r")).select("record_id", "r.*")
    rows = drift.united(cells, drift.schema_changes(cells), ["copy"])
    out = last.join(rows.select("copy", "lines", "texts"), "copy", "left")
    nothing = F.when(F.col("kind").isNull(), "payload").when(F.col("family").isNull() | F.col("edition").isNull(), "file")
    return out.select(
        "record_id", F.col("family").alias("source"), F.col("edition").alias("book_year"),
        F.coalesce("lines", F.expr("cast(map() as map<string, double>)")).alias("lines"),
        F.coalesce("texts", F.expr("cast(map() as map<string, string>)")).alias("texts"),
        nothing.alias("rejected"),
    )
