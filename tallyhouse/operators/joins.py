"""Joins beyond equality: precedence, chains, intervals, nearest in time or value, token sets, places, polygons, graphs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tallyhouse.operators.near import haversine_m
from tallyhouse.session import drop_staged, stage, staged


def by_precedence(base: DataFrame, sources: list[tuple[str, DataFrame]], keys: list[str], value: str) -> DataFrame:
    """``base`` with ``value`` from the first source that has one, and the name of that source as ``origin``."""
    out = base
    for i, (_, s) in enumerate(sources):
        out = out.join(s.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
    origin = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(sources)])
    got = F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])
    return out.withColumn(value, got).withColumn("origin", origin).drop(*[f"_v{i}" for i in range(len(sources))])


def full_profile(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """All keys of several tables (``key`` plus columns each), with the list of tables that know the key."""
    out: DataFrame | None = None
    for name, s in sources.items():
        s = s.withColumn(f"_in_{name}", F.lit(name))
        out = s if out is None else out.join(s, key, "full")
    known = F.array_compact(F.array(*[F.col(f"_in_{n}") for n in sources]))
    return out.withColumn("known_in", known).drop(*[f"_in_{n}" for n in sources])


def with_earlier(df: DataFrame, keys: list[str], year: str, value: str, back: int = 2) -> DataFrame:
    """A missing value from up to ``back`` years before, and the year it is from."""
    w = Window.partitionBy(*keys).orderBy(year)
    options = [F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(year).alias("y")))]
    for i in range(1, back + 1):
        for j in range(1, back + 1):
            was = F.lag(year, j).over(w)
            options.append(F.when((was == F.col(year) - i) & F.lag(value, j).over(w).isNotNull(), F.struct(F.lag(value, j).over(w).alias("v"), was.alias("y"))))
    return df.withColumn("_e", F.coalesce(*options)).withColumn(f"{value}_known", F.col("_e.v")).withColumn(f"{value}_year", F.col("_e.y")).drop("_e")


def chains(links: DataFrame, start: str, to: str, hops: int = 3) -> DataFrame:
    """(start, reached, hops): everything within ``hops`` links, by the shortest way, never coming back to the start."""
    edges = links.select(F.col(start).alias("a"), F.col(to).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    found = edges.select(F.col("a").alias("start"), F.col("b").alias("reached"), F.lit(1).alias("hops"))
    step = found
    for h in range(2, hops + 1):
        step = step.join(edges, step.reached == edges.a).where(F.col("b") != F.col("start")).select("start", F.col("b").alias("reached")).distinct()
        step = step.withColumn("hops", F.lit(h))
        found = found.unionByName(step)
    return found.groupBy("start", "reached").agg(F.min("hops").alias("hops"))


def interval_unique(left: DataFrame, right: DataFrame, keys: list[str], ident: str, at: str, to: str, low: int, high: int) -> DataFrame:
    """(ident, match): the one right row of the same keys whose ``to`` is ``low`` to ``high`` days after ``at``, or null."""
    r = right.select(*keys, F.col(ident).alias("_r"), F.col(to).alias("_to"))
    gap = F.datediff("_to", F.col(at))
    hit = left.select(*keys, F.col(ident), F.col(at)).join(r, keys).where(gap.between(low, high) & (F.col("_r") != F.col(ident)))
    one = hit.groupBy(ident).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    return left.select(ident).distinct().join(one, ident, "left").select(ident, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("match"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value_at: str, ident: str) -> DataFrame:
    """``left`` with the right row nearest in time (``near_id``, ``near_at``): of equally near ones the earlier.

    Both tables are laid into one order per key; the nearest before and after come from running windows, so no pairs are
    formed.  A key's rows are ordered in one task; keys of very many rows can carry a coarser period in ``key``.
    """
    l = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.col(ident).alias("_id"), F.lit(None).cast("string").alias("_rid"))  # noqa: E741
    r = right.select(F.col(key).alias("_k"), F.col(value_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[ident].dataType).alias("_id"), F.col("near_id").cast("string").alias("_rid"))
    both = l.unionByName(r)
    mark = F.when(F.col("_side") == 0, F.struct("_t", "_rid"))
    w = Window.partitionBy("_k")
    before = F.last(mark, True).over(w.orderBy("_t", "_side", F.col("_rid").desc()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(mark, True).over(w.orderBy(F.col("_t").desc(), "_side", F.col("_rid").desc()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", before).withColumn("_a", after).where("_side = 1")
    gap_b = F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_b._t").cast("timestamp")))
    gap_a = F.abs(F.unix_micros(F.col("_a._t").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    near = F.when(F.col("_a").isNull() | (gap_b <= gap_a), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_n", near).select(F.col("_id").alias(ident), F.col("_n._rid").alias("near_id"), F.col("_n._t").alias("near_at"))


def tokens(name: Column, stop: list[str]) -> Column:
    """Sorted distinct words of a name without stop words; a plural s is dropped from words of four letters or more."""
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " ")
    words = F.transform(words, lambda w: F.when((F.length(w) >= 4) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stop))))


def token_set_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match, how) for ``left`` (id, tokens) against ``right`` (rid, tokens): equal sets, else a strict subset either
    way, each only where exactly one right row fits.

    Subsets are found through the rarest word of the smaller set, which the larger must contain; equality through the set.
    """
    equal = left.join(right, "tokens").groupBy("id").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    df = right.select(F.explode("tokens").alias("t")).unionAll(left.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def rarest(d: DataFrame, ident: str) -> DataFrame:
        e = d.select(ident, F.explode("tokens").alias("t")).join(df, "t")
        return d.join(e.groupBy(ident).agg(F.min(F.struct("n", "t")).alias("m")).select(ident, F.col("m.t").alias("t")), ident)

    a = rarest(left, "id").withColumnRenamed("tokens", "lt").join(right.select("rid", F.col("tokens").alias("rt"), F.explode("tokens").alias("t")), "t")
    b = rarest(right, "rid").withColumnRenamed("tokens", "rt").join(left.select("id", F.col("tokens").alias("lt"), F.explode("tokens").alias("t")), "t")
    cols = ["id", "rid", "lt", "rt"]
    inside = (F.size(F.array_except("lt", "rt")) == 0) | (F.size(F.array_except("rt", "lt")) == 0)
    sub = a.select(cols).unionByName(b.select(cols)).where(inside & (F.col("lt") != F.col("rt"))).select("id", "rid").distinct()
    sub = sub.groupBy("id").agg(F.min("rid").alias("slo"), F.max("rid").alias("shi"))
    out = left.select("id").join(equal, "id", "left").join(sub, "id", "left")
    return out.select(
        "id",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNull() & (F.col("slo") == F.col("shi")), F.col("slo")).alias("match"),
        F.when(F.col("lo") == F.col("hi"), "equal").when(F.col("lo").isNull() & (F.col("slo") == F.col("shi")), "subset").alias("how"),
    ).where("match is not null")


def nearest_values(df: DataFrame, block: list[str], ident: str, measures: dict[str, float], k: int) -> DataFrame:
    """(block, ident, other, distance, place): the k nearest others of a block by the sum of scaled absolute differences.

    Exact: rows are cut into cells of width 1 by the first scaled measure; a row meets the cells around its own, ring by
    ring, until its k-th distance is no more than the rings searched so far prove complete.
    """
    names = list(measures)
    x = df.select(*block, F.col(ident).alias("_a"), *[(F.col(m) / s).alias(f"_{i}") for i, (m, s) in enumerate(measures.items())])
    x = staged(x.where(" and ".join(f"_{i} is not null" for i in range(len(names)))).withColumn("_cell", F.floor("_0").cast("long")), "knn")
    other = x.select(*block, F.col("_a").alias("_b"), F.col("_cell").alias("_bc"), *[F.col(f"_{i}").alias(f"_o{i}") for i in range(len(names))])
    span = x.agg(F.max("_cell") - F.min("_cell")).first()[0] or 0
    sizes = x.groupBy(*block).agg((F.count(F.lit(1)) - 1).alias("_others"))
    todo, ring, found = x.join(sizes, block), 1, None
    while True:
        cells = F.sequence(F.col("_cell") - ring, F.col("_cell") + ring)
        pairs = todo.withColumn("_bc", F.explode(cells)).join(other, [*block, "_bc"]).where("_a <> _b")
        d = sum((F.abs(F.col(f"_{i}") - F.col(f"_o{i}")) for i in range(len(names))), F.lit(0.0))
        w = Window.partitionBy(*block, "_a").orderBy("distance", "_b")
        near = pairs.withColumn("distance", d).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        near = staged(near.select(*block, "_a", "_b", "distance", "place", "_others"), f"knn-{ring}")
        full = near.groupBy(*block, "_a").agg(F.max("distance").alias("_d"), F.max("place").alias("_p"), F.first("_others").alias("_others"))
        done = full.where(((F.col("_p") == F.least(F.lit(k), F.col("_others"))) & (F.col("_d") <= ring)) | F.lit(ring >= span + 1))
        good = near.join(done.select(*block, "_a"), [*block, "_a"], "left_semi").drop("_others")
        found = good if found is None else found.unionByName(good)
        if ring >= span + 1:
            break
        todo = todo.join(done.select(*block, "_a"), [*block, "_a"], "left_anti")
        if todo.isEmpty():
            break
        ring *= 4
    return found.select(*block, F.col("_a").alias(ident), F.col("_b").alias("other"), "distance", "place")


def within_metres(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(id, rid, metres) of left (id, lat, lon) and right (rid, rlat, rlon) points at most ``metres`` apart, by grid cells.

    Rows of cells are as high as the radius; a row is cut around the whole circle of latitude into cells as wide as the radius
    is there at most, fewer towards the poles, so neither the date line nor a pole hides a pair.
    """
    deg = float(metres / 111_194.9 * 1.0001)

    def cells(row: Column) -> Column:
        """How many cells a row of latitude has: 1 where the radius may reach around the pole."""
        edge = F.greatest(F.abs(row * deg), F.abs((row + 1) * deg)) + deg
        sine = F.sin(F.radians(F.lit(deg))) / F.cos(F.radians(F.least(edge, F.lit(89.9))))
        width = F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * (1 + 1e-9)
        return F.when((edge + deg >= 89.9) | (sine >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / width), F.lit(1))).cast("long")

    at = lambda lon, n: F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("long")
    r = right.withColumn("_cy", F.floor(F.col("rlat") / deg).cast("long"))
    r = r.withColumn("_cx", at(F.col("rlon"), cells(F.col("_cy"))))
    row = F.floor(F.col("lat") / deg).cast("long")
    l = left.withColumn("_cy", F.explode(F.sequence(row - 1, row + 1))).withColumn("_n", cells(F.col("_cy")))  # noqa: E741
    x = at(F.col("lon"), F.col("_n"))
    l = l.withColumn("_cx", F.explode(F.array_distinct(F.array(F.pmod(x - 1, F.col("_n")), x, F.pmod(x + 1, F.col("_n"))))))  # noqa: E741
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    return l.join(r, ["_cy", "_cx"]).select("id", "rid", d.alias("metres")).where(F.col("metres") <= metres)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring, an array of structs (x, y); points on an edge go to either side."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        above = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) * F.try_divide(q["x"] - p["x"], q["y"] - p["y"])
        return above & (x < at)

    hits = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(crosses(e), 1).otherwise(0))
    return (hits % 2) == 1


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test against all rings of a polygon or of several apart from each other: a point in a hole is outside."""
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != F.coalesce(inside_ring(x, y, r), F.lit(False)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(id, pid) for points (id, x, y) and polygons (pid, ring), or (pid, rings) as ``features`` gives them, with holes: a polygon is
    laid on the grid cells of its box, a point meets the polygons of its cell, and the even-odd test decides."""
    shape = "rings" if "rings" in polygons.columns else "ring"
    corners = F.flatten("rings") if shape == "rings" else F.col("ring")
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    boxed = polygons.select("pid", shape, *[f(a).alias(n) for n, f, a in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))])
    g = lambda c: F.floor(F.col(c) / cell).cast("long")
    boxed = boxed.withColumn("_cx", F.explode(F.sequence(g("x0"), g("x1")))).withColumn("_cy", F.explode(F.sequence(g("y0"), g("y1"))))
    p = points.withColumn("_cx", g("x")).withColumn("_cy", g("y"))
    test = inside_rings if shape == "rings" else inside_ring
    return p.join(boxed, ["_cx", "_cy"]).where(test(F.col("x"), F.col("y"), F.col(shape))).select("id", "pid")


def ring_centroid(ring: Column) -> Column:
    """(area, x, y) of a closed ring by the shoelace formula; the area is signed, and null with x and y for a line."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    s = F.aggregate(
        pairs, zero,
        lambda acc, e: F.struct(
            (acc["a"] + cross(e)).alias("a"), (acc["x"] + (e["p"]["x"] + e["q"]["x"]) * cross(e)).alias("x"),
            (acc["y"] + (e["p"]["y"] + e["q"]["y"]) * cross(e)).alias("y"),
        ),
    )
    a = F.nullif(s["a"], F.lit(0.0))
    return F.struct((a / 2).alias("area"), F.try_divide(s["x"], 3 * a).alias("x"), F.try_divide(s["y"], 3 * a).alias("y"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest one it knows, so the
    number of rounds grows with the logarithm of the longest chain.  Every round is cut by a table in the shared folder, which
    is dropped when the next one is written.  Edges that don't settle within ``rounds`` are an error.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = staged(e.select("u").union(e.select("v")).distinct(), "nodes")
    e, path = stage(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for i in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v").distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, new = stage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges-{i}")
        drop_staged(edges.sparkSession, path)
        path = new
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            root = e.groupBy("u").agg(F.min("v").alias("component"))
            return nodes.join(root, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
        before = now
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _scalars(text: str | None) -> list[tuple[str, str | None]]:
    """(path, text) of all scalars of a JSON text, to any depth; an empty object or array is one of its own."""
    try:
        todo = [("", json.loads(text))] if text is not None else []
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str | None]] = []
    while todo:
        path, value = todo.pop()
        parts = value.items() if isinstance(value, dict) else ((f"#{i}", v) for i, v in enumerate(value)) if isinstance(value, list) else None
        if parts is None or not value and isinstance(value, (dict, list)):
            if path:
                out.append((path, value if isinstance(value, str) else None if value is None else json.dumps(value)))
        else:
            todo += [(f"{path}.{k}" if path else k, v) for k, v in parts]
    return out


def structural_diff(left: DataFrame, right: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, path, old, new) of every scalar that differs between two JSON documents of a key, to any depth of nesting.

    Elements of arrays are named by their place (``#0``); JSON null is like a missing value; texts that can't be read have
    no scalars.
    """
    flat_type = ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())]))

    def scalars(texts: pd.Series) -> pd.Series:
        return texts.map(_scalars)

    read = F.pandas_udf(scalars, flat_type)

    def flat(d: DataFrame, out: str) -> DataFrame:
        return d.select(key, F.explode(read(F.col(doc))).alias("e")).select(key, F.col("e.path").alias("path"), F.col("e.value").alias(out))

    both = flat(left, "old").join(flat(right, "new"), [key, "path"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def with_sections(base: DataFrame, sections: dict[str, DataFrame], key: str) -> DataFrame:
    """``base`` left-joined with tables of at most one row a key, each as a struct of its name, and the list of those present."""
    out, names = base, list(sections)
    for n, s in sections.items():
        body = F.struct(*[F.col(c) for c in s.columns if c != key])
        out = out.join(s.select(F.col(key), body.alias(n)), key, "left")
    return out.withColumn("sections", F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])))


def first_row_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A lookup table: of the rows of a key the first in ``order``; rows without key are left out."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(key, "_r.*")


def by_group_or_all(df: DataFrame, benchmarks: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """``df`` with a benchmark of its keys and group or, where there is none, of the group ``all``; ``basis`` says which."""
    b = benchmarks.where(F.col(value).isNotNull())
    own = b.select(*keys, group, F.col(value).alias("_own"))
    every = b.where(F.col(group) == "all").select(*keys, F.col(value).alias("_all"))
    out = df.join(own, [*keys, group], "left").join(every, keys, "left")
    basis = F.when(F.col("_own").isNotNull(), "own").when(F.col("_all").isNotNull(), "all")
    return out.withColumn(value, F.coalesce("_own", "_all")).withColumn("basis", basis).drop("_own", "_all")


def attach_series(base: DataFrame, returns: DataFrame, key: str, period: str, known: Column, order: list[str]) -> DataFrame:
    """One-to-many: the rows of ``returns`` of every key of ``base``, one a period; a row for which ``known`` holds goes before
    one that withholds its figures, then the last in ``order``.  ``age`` is 1 for the latest period of a key."""
    from tallyhouse.operators.panel import keep_last

    r = keep_last(returns.withColumn("_known", F.coalesce(known, F.lit(False))), [key, period], [F.col("_known"), *[F.col(c) for c in order]])
    w = Window.partitionBy(key).orderBy(F.col(period).desc())
    return base.select(key).distinct().join(r.drop("_known"), key).withColumn("age", F.row_number().over(w))


def first_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(id, pid): of the polygons that hold a point the first by ``pid``."""
    return points_in_polygons(points, polygons, cell).groupBy("id").agg(F.min("pid").alias("pid"))


def code_map(df: DataFrame, many: str, one: str, order: str) -> DataFrame:
    """(``many``, ``one``): the code that the first row in ``order`` gives each of many codes; equal places by the smaller code."""
    return df.where(F.col(many).isNotNull() & F.col(one).isNotNull()).groupBy(many).agg(F.min_by(one, F.struct(order, one)).alias(one))
