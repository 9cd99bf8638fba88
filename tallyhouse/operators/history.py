"""Full history of changing entity attributes from periodic snapshots, by Merkle comparison.

The hash of a key places it in a radix tree: the first bits name a node, each further ``bits`` one of its children, and the
leaves are as deep as the rows need.  For every snapshot a node is one row that holds the digests of its children, so a tree
level is 1 / 2 ** bits of the level below.  The comparison starts at the root: the children's digests of a node are compared
with those of the snapshot before, and only children that differ are opened.  In the end only the rows of leaves that still
differ are read, diffed, and their new versions kept.

Rows are resolved by an aggregation that combines before it shuffles, and written as fixed-width columns, neighbouring leaves
to one file; after that only digests and the rows of changed leaves move.  The table itself is read once, the resolved rows
twice (digests, changed leaves).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyhouse.session import staged


def fingerprint(state: Sequence[Column]) -> Column:
    """64-bit hash of a state; a null differs from every value, and neighbouring columns can't run into each other."""
    parts: list[Column] = []
    for c in state:
        parts += [F.isnull(c).cast("int"), c]
    return F.xxhash64(*parts)


def _depth(n_rows: int, rows_per_leaf: int, bits: int) -> int:
    """Levels below the root, so that a leaf holds about ``rows_per_leaf`` rows of all snapshots; 1 to 60 // bits."""
    depth, leaves = 1, 1 << bits
    while leaves * max(1, rows_per_leaf) < n_rows and (depth + 1) * bits <= 60:
        depth, leaves = depth + 1, leaves << bits
    return depth


def _node(h: Column, level: int, bits: int) -> Column:
    """The node of a level that a hash lies under: its first ``level * bits`` bits."""
    return F.shiftrightunsigned(h, 64 - level * bits)


def _digest(parts: Column) -> list[Column]:
    """Two independent 64-bit digests of a set of hashed parts; the order of the parts plays no role."""
    return [F.bit_xor(F.xxhash64(F.lit(i), parts)).alias(f"d{i}") for i in (1, 2)]


def _folded(kids: str, seed: int) -> Column:
    """The digest of a node from those of its children."""
    one = lambda k: F.xxhash64(F.lit(seed), k["kid"], k["d1"], k["d2"], k["n"])
    return F.aggregate(kids, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(one(k)))


def merkle_levels(rows: DataFrame, depth: int, bits: int) -> list[DataFrame]:
    """The inner levels of the tree, root first: (_node, _at, kids: array of (kid, d1, d2, n)).

    ``rows``: _h (hash of the key), _key, _at, _fp (fingerprint of the state).  The lowest level is written once, those above
    it, a sixteenth of it or so, together in one more pass.
    """
    kid = F.struct(F.col("_kid").alias("kid"), "d1", "d2", "n")

    def above(kids: DataFrame, level: int) -> DataFrame:
        parent = F.shiftrightunsigned("_kid", bits) if level else F.lit(0).cast("long")
        # At most 2 ** bits children: the array is bounded.
        return kids.groupBy(parent.alias("_node"), "_at").agg(F.array_sort(F.collect_list(kid)).alias("kids"))

    leaves = rows.groupBy(_node(F.col("_h"), depth, bits).alias("_kid"), "_at").agg(
        *_digest(F.struct("_key", "_fp")), F.count(F.lit(1)).alias("n")
    )
    out = [staged(above(leaves, depth - 1), "lowest")]
    for level in range(depth - 2, -1, -1):
        kids = out[0].select(
            F.col("_node").alias("_kid"), "_at", _folded("kids", 1).alias("d1"), _folded("kids", 2).alias("d2"),
            F.aggregate("kids", F.lit(0).cast("long"), lambda acc, k: acc + k["n"]).alias("n"),
        )
        out.insert(0, above(kids, level))
    if depth > 1:
        upper = reduce(DataFrame.unionByName, [d.withColumn("_level", F.lit(i)) for i, d in enumerate(out[:-1])])
        upper = staged(upper, "upper")
        out[:-1] = [upper.where(F.col("_level") == i).drop("_level") for i in range(depth - 1)]
    return out


def changed_leaves(levels: list[DataFrame], compared: list[int] | None = None) -> DataFrame:
    """(_node, _at): leaves that differ from the snapshot before, found from the root down.

    A node is opened only if its parent's row of children says that it differs; what its children were is looked up in the
    node's row of the snapshot before.  ``compared``, if given, receives the number of nodes compared at each level.
    """
    # One root row a snapshot: their order is known from a window over as many rows as there are snapshots.
    when = levels[0].select("_node", "_at", F.lag("_at").over(Window.orderBy("_at")).alias("_was"))
    changed = when
    for nodes in levels:
        now = changed.join(nodes, ["_node", "_at"])
        was = nodes.select("_node", F.col("_at").alias("_was"), F.col("kids").alias("_old"))
        both = now.join(was, ["_node", "_was"], "left")
        if compared is not None:
            compared.append(both.agg(F.coalesce(F.sum(F.size("kids")), F.lit(0))).first()[0])
        new = F.array_except("kids", F.coalesce("_old", F.slice("kids", 1, 0)))
        changed = both.select(F.explode(new).alias("k"), "_at", "_was").select(F.col("k.kid").alias("_node"), "_at", "_was")
    return changed.select("_node", "_at")


def attribute_history(
    snapshots: DataFrame,
    *,
    key: str,
    snapshot: str,
    loaded: str,
    state: dict[str, Column],
    keep_state: bool = False,
    rows_per_leaf: int = 512,
    bits: int = 4,
    compared: list[int] | None = None,
) -> DataFrame:
    """One row per version of an entity: ``key``, ``valid_from``, ``valid_to`` (null for the last), and with
    ``keep_state`` the columns named in ``state``.

    A version is a longest run of successive snapshots of a key that agree in all ``state`` expressions.  A snapshot in
    which the key is missing doesn't end a run, and a state that comes back is a new version.

    * Rows without key or snapshot date are left out: they belong to no entity or no time.
    * Of several rows for a key and snapshot the one with the latest ``loaded`` counts (null is earliest); between rows
      loaded at the same moment the larger fingerprint counts, so the result doesn't depend on row order.
    * Null state values agree with null only.  An empty table gives an empty history.
    * Only the named columns are read; other columns, whatever their names, play no part.

    ``rows_per_leaf`` and ``bits`` (2 ** bits children a node) shape the tree and never change the result; ``compared``
    receives the number of nodes compared at each level, root first.
    """
    src = snapshots.select(
        F.col(key).alias("_key"),
        F.col(snapshot).cast("date").alias("_at"),
        F.unix_micros(F.col(loaded).cast("timestamp")).alias("_loaded"),
        *[c.alias(f"_s{i}") for i, c in enumerate(state.values())],
    ).where(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    names = [f"_s{i}" for i in range(len(state))]

    # The order of loads as one fixed-width number, the fingerprint its last 64 bits: resolving is a hash aggregation that
    # combines before it shuffles, so a key sent again and again costs no task more than one row a snapshot.
    load = F.coalesce(F.col("_loaded"), F.lit(-(10**17))).cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)")
    rank = load + F.col("_fp").cast("decimal(20,0)")
    rows = src.select("_key", "_at", "_loaded", fingerprint([F.col(n) for n in names]).alias("_fp"))
    rows = rows.groupBy("_key", "_at").agg(F.max_by("_fp", rank).alias("_fp"))
    # A million stretches of the hash keep neighbouring leaves in one file, however deep the tree will be.
    seen = Observation()
    rows = rows.repartition(F.shiftrightunsigned(F.xxhash64("_key"), 44)).observe(seen, F.count(F.lit(1)).alias("n"))
    rows = staged(rows.select("_key", "_at", "_fp"), "resolved").withColumn("_h", F.xxhash64("_key"))
    depth = _depth(seen.get["n"], rows_per_leaf, bits)
    leaves = changed_leaves(merkle_levels(rows, depth, bits), compared)
    kept = rows.withColumn("_node", _node(F.col("_h"), depth, bits)).join(leaves, ["_node", "_at"], "left_semi")

    by_key = Window.partitionBy("_key")
    order = by_key.orderBy("_at")
    starts = kept.withColumn("_was", F.lag("_fp").over(order)).where(
        F.col("_was").isNull() | (F.col("_was") != F.col("_fp"))
    )
    versions = starts.withColumn("_until", F.lead("_at").over(order))
    if not keep_state:
        return versions.select(
            F.col("_key").alias(key), F.col("_at").alias("valid_from"), F.col("_until").alias("valid_to")
        )
    values = src.withColumn("_fp", fingerprint([F.col(n) for n in names])).select("_key", "_at", "_fp", *names)
    values = values.groupBy("_key", "_at", "_fp").agg(*[F.first(n).alias(n) for n in names])
    return versions.join(values, ["_key", "_at", "_fp"]).select(
        F.col("_key").alias(key),
        F.col("_at").alias("valid_from"),
        F.col("_until").alias("valid_to"),
        *[F.col(f"_s{i}").alias(n) for i, n in enumerate(state)],
    )
