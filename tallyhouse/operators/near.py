"""Points near other points: latitude strips, a sweep in order of longitude, one owner for each pair.

Latitude is range-partitioned into strips not lower than the radius, each strip into longitude segments not narrower than
it.  A point is copied into the strip above and the segment to the right where it lies within the radius of that border, so
every pair within the radius meets in the cell (highest strip, rightmost segment) of the two; only that cell owns it.  In a
cell the points arrive ordered by longitude and are swept with an active set that holds no more than the radius behind, so
memory follows the density of points and not the size of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import staged

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _cells(points: DataFrame, metres: float, sphere: float, strips: float, segments: float) -> DataFrame:
    """Points with their cells: own strip and, near its upper border, the next; in each, own segment and the next."""
    deg = float(np.degrees(metres / sphere)) * (1 + 1e-9)
    height = deg * strips
    strip = F.floor((F.col("lat") + 90) / height).cast("long")
    near_top = (F.col("lat") + 90) - strip * height >= height - deg
    p = points.withColumn("home", strip).withColumn(
        "strip", F.explode(F.when(near_top, F.array("home", F.col("home") + 1)).otherwise(F.array("home")))
    )
    # The widest longitude difference of a pair within the radius, from the latitude of the strip's (or its copies') edge.
    edge = F.greatest(F.abs(F.col("strip") * height - 90 - deg), F.abs((F.col("strip") + 1) * height - 90 + deg))
    ratio = F.sin(F.lit(float(np.radians(deg)))) / F.cos(F.radians(F.least(edge, F.lit(89.999999))))
    dlon = F.when((edge + deg >= 90) | (ratio >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    p = p.withColumn("dlon", dlon).withColumn("width", F.least(F.col("dlon") * segments, F.lit(720.0)))
    # Across the date line: a second copy one turn to the west, which meets the points just east of the line.
    ghost = (F.col("lon") + F.col("dlon") >= 180) & (F.col("dlon") < 360)
    turns = F.when(ghost, F.array(F.lit(0.0), F.lit(-360.0))).otherwise(F.array(F.lit(0.0)))
    p = p.withColumn("turn", F.explode(turns)).withColumn("lon", F.col("lon") + F.col("turn"))
    p = p.withColumn("seg", F.floor((F.col("lon") + 720) / F.col("width")).cast("long"))
    near_right = (F.col("lon") + 720) - F.col("seg") * F.col("width") >= F.col("width") - F.col("dlon")
    return p.withColumn(
        "cell", F.explode(F.when(near_right, F.array("seg", F.col("seg") + 1)).otherwise(F.array("seg")))
    ).select("strip", "cell", "lon", "lat", "home", "seg", "dlon", (F.col("turn") < 0).alias("ghost"), "point")


def _sweeper(metres: float, sphere: float):  # noqa: ANN202
    out_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("metres", pa.float64())])
    names = ("strip", "cell", "lon", "lat", "home", "seg", "dlon", "ghost", "point")

    def sweep_block(old: dict[str, np.ndarray], new: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of a new point with an old one or an earlier new one; both are ordered by longitude, of one cell."""
        x = {n: np.concatenate([old[n], new[n]]) for n in names}
        k, start = len(x["lon"]), len(old["lon"])
        lo = np.searchsorted(x["lon"], x["lon"][start:] - x["dlon"][start:], side="left")
        counts = np.arange(start, k) - lo
        at = 0
        while at < len(counts):  # a bounded number of candidates at once
            stop = at + max(1, int(np.searchsorted(np.cumsum(counts[at:]), 1_000_000, side="right")))
            c = counts[at:stop]
            j = np.repeat(np.arange(start + at, start + stop), c)
            i = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[at:stop], c)
            own = (
                (np.maximum(x["home"][i], x["home"][j]) == x["strip"][j])
                & (np.maximum(x["seg"][i], x["seg"][j]) == x["cell"][j])
                & ~(x["ghost"][i] & x["ghost"][j])
                & (x["point"][i] != x["point"][j])
            )
            i, j = i[own], j[own]
            d = _haversine(x["lat"][i], x["lon"][i], x["lat"][j], x["lon"][j], sphere)
            near = d <= metres
            a, b = x["point"][i[near]], x["point"][j[near]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[near])], schema=out_schema
            )
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            edges = np.flatnonzero((np.diff(x["strip"]) != 0) | (np.diff(x["cell"]) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                new = {n: v[lo:hi] for n, v in x.items()}
                if active is None or active["strip"][0] != new["strip"][0] or active["cell"][0] != new["cell"][0]:
                    active = {n: v[:0] for n, v in new.items()}
                yield from sweep_block(active, new)
                both = {n: np.concatenate([active[n], new[n]]) for n in names}
                keep = np.searchsorted(both["lon"], both["lon"][-1] - both["dlon"][-1], side="left")
                active = {n: v[keep:] for n, v in both.items()}

    return run


def near_points(
    points: DataFrame, metres: float, *, sphere: float = EARTH_M, strips: float = 2.0, segments: float = 16.0
) -> DataFrame:
    """Pairs (``a`` < ``b``, ``metres``) of different points at most ``metres`` apart, each pair once.

    ``points`` has ``point`` (bigint, unique), ``lat`` and ``lon``.  Points with a null or non-finite coordinate, or one
    outside -90..90 and -180..180, have no place and pair with nothing.  ``strips`` and ``segments`` are the size of a
    cell in radii (1 at least); they move work between copies and candidates and never change the result.
    """
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    p = points.select(F.col("point").cast("long").alias("point"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    cells = _cells(p.where(ok & F.col("point").isNotNull()), float(metres), sphere, max(1.0, strips), max(1.0, segments))
    ordered = cells.repartitionByRange("strip", "cell").sortWithinPartitions("strip", "cell", "lon")
    return ordered.mapInArrow(_sweeper(float(metres), sphere), "a long, b long, metres double")


def near_members(
    members: DataFrame, metres: float, *, id_col: str = "id", one_place: bool = False, block: int = 1024, **options: float
) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of ids at most ``metres`` apart, from rows (``id_col``, ``lat``, ``lon``).

    Ids at the very same position are swept as one point.  A position's ids lie in hashed blocks of about ``block``; near
    positions, and a position with itself, become pairs of blocks, each of which is spread out on its own, so neither a
    position that holds a large part of all rows nor two of them load one task.  An id given twice pairs once; an id with
    two places pairs from both, never with itself.  ``one_place`` says that no id has two places: then no pair can come
    twice, and the pairs, which outnumber the rows, are not shuffled to find out.
    """
    m = members.select(
        F.col(id_col).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    ).where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).distinct()
    # 64 bits name a position: among 10^8 positions two share a name with a chance below 0.0003.
    m = m.withColumn("point", F.xxhash64("lat", "lon"))
    width = m.groupBy("point").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    blocks = m.join(width, "point").withColumn("at", F.pmod(F.xxhash64("id", F.lit(1)), F.col("k")).cast("int"))
    blocks = blocks.groupBy("point", "k", "at").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.collect_list("id").alias("ids"))
    blocks = staged(blocks, "blocks")

    side = lambda p, *cols: blocks.select(F.col("point").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    # A block may stay empty, the first of a position too, so positions are named by their distinct rows.
    places = blocks.groupBy("point").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("k").alias("k"), F.sum(F.size("ids")).alias("n"))
    same = places.where("n > 1").select(F.col("point").alias("a"), F.col("point").alias("b"), F.col("k").alias("a_k"), F.col("k").alias("b_k"))
    pairs = near_points(places, metres, **options).select("a", "b")
    for p in ("a", "b"):
        pairs = pairs.join(places.select(F.col("point").alias(p), F.col("k").alias(f"{p}_k")), p)
    pairs = pairs.select(*same.columns).unionByName(same)
    pairs = pairs.withColumn("a_at", F.explode(F.sequence(F.lit(0), F.col("a_k") - 1)))
    first = F.when(F.col("a") == F.col("b"), F.col("a_at")).otherwise(0)
    pairs = pairs.withColumn("b_at", F.explode(F.sequence(first, F.col("b_k") - 1)))
    both = pairs.select("a", "a_at", "b", "b_at").join(side("a", "at", "ids"), ["a", "a_at"]).join(side("b", "at", "ids"), ["b", "b_at"])
    both = both.repartition("a", "a_at", "b", "b_at").withColumn("_x", F.explode("a_ids")).withColumn("_y", F.explode("b_ids"))
    within = (F.col("a") != F.col("b")) | (F.col("a_at") != F.col("b_at")) | (F.col("_x") < F.col("_y"))
    out = both.where(within & (F.col("_x") != F.col("_y"))).select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
    return out if one_place else out.distinct()
