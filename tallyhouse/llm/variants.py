"""Variant spellings: a prefix-filtered set-similarity join on letter q-grams, verified by soft weighted word similarity.

Both sides become sets of q-grams of their distinctive words.  A q-gram weighs the square of the log of how rare it is among
the known names, nothing if none has it.  With the q-grams ordered from rare to frequent, two sets of weighted Jaccard
similarity t or more share one among the first of either, as far as the rest weighs t of the whole or more, so only those
are joined, inside a block (a place) where there is one.  Survivors are compared word by word; rare words weigh more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, StringType, StructField, StructType

from tallyhouse.llm import names
from tallyhouse.session import staged

#: Letters a to z and the two marks of start and end: there are no more q-grams than 28 ** 3, so their counts may be broadcast.
ALPHABET = 28

#: Types are spelt out: a type in words is only understood where a session runs.
WORDS = ArrayType(StringType())
PARSED = StructType([StructField("core", WORDS), StructField("kinds", WORDS), StructField("grams", WORDS)])


@F.pandas_udf(PARSED)
def parsed(text: pd.Series) -> pd.DataFrame:
    """(core, kinds, grams) of typed names; each different text of a batch is analysed once."""
    once = {t: names.analyse(t) for t in text.unique()}
    rows = [once[t] for t in text]
    return pd.DataFrame({"core": [r[0] for r in rows], "kinds": [r[1] for r in rows], "grams": [names.grams(r[0]) for r in rows]})


@F.pandas_udf(PARSED)
def parsed_at(text: pd.Series, place: pd.Series) -> pd.DataFrame:
    """As ``parsed``, without the words of the place the name is typed for."""
    rows = []
    for t, p in zip(text, place):
        core, kinds = names.analyse(t)
        rows.append((names.without_place(core, names.squeeze(p).replace("-", " ").split()), kinds))
    return pd.DataFrame({"core": [r[0] for r in rows], "kinds": [r[1] for r in rows], "grams": [names.grams(r[0]) for r in rows]})


@F.pandas_udf(WORDS)
def grams_of(core: pd.Series) -> pd.Series:
    """The letter q-grams of words found before."""
    return core.map(lambda c: names.grams(list(c)) if c is not None else [])


def word_weights(named: DataFrame, ident: str = "id") -> DataFrame:
    """(``ident``, weights): for each word of ``core`` the log of how rare it is among all names, common second words less."""
    one = named.select(ident, F.posexplode("core").alias("pos", "word"))
    df = named.select(F.explode(F.array_distinct("core")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(named.count())
    w = F.log1p(n / F.col("df")) * F.when(F.col("word").isin(*sorted(names.COMMON | names.TITLES)), F.lit(0.6)).otherwise(F.lit(1.0))
    scored = large_join(one, df, "word").select(ident, "pos", w.alias("w"))
    return scored.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_w")).select(
        ident, F.transform("_w", lambda x: x["w"]).alias("weights")
    )


def large_join(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data.

    A staged table is small on disk, and a few of its columns look smaller still, so its size is no proof that it may be
    broadcast: the hint keeps it from being.
    """
    return a.join(b.hint("merge"), on, how)


#: Rare q-grams of a set, for each of them what it and the more frequent ones weigh, and the weight of the whole set.
PREFIX = StructType([StructField("first", WORDS), StructField("rest", ArrayType(FloatType())), StructField("weight", DoubleType())])


def gram_weight(df: int, n: int) -> float:
    """Of a q-gram that ``df`` of ``n`` known names have."""
    return math.log1p(n / df) ** 2 if df else 0.0


def even_weight(df: int, n: int) -> float:
    """All q-grams alike: the similarity is the plain Jaccard index."""
    return 1.0


def _prefix(shared: Broadcast, n: int, weigh: Callable[[int, int], float]):  # noqa: ANN202
    def first(grams: pd.Series, threshold: pd.Series) -> pd.DataFrame:
        out, counts = [], shared.value
        for g, t in zip(grams, threshold):
            x = sorted((counts[w], w) for w in g if w in counts) if g is not None else []
            weights = [weigh(df, n) for df, _ in x]
            # Those that no known name has are the rarest and come first, but lead nowhere.
            rest = sum(weights)
            whole = rest + weigh(0, n) * ((len(g) if g is not None else 0) - len(x))
            kept, left = [], []
            for (_, gram), w in zip(x, weights):
                if rest < t * whole - 1e-9:
                    break
                kept.append(gram)
                left.append(rest * 1.000001)  # never less than it is when it is a float
                rest -= w
            out.append((kept, left, whole))
        return pd.DataFrame(out, columns=["first", "rest", "weight"])

    return F.pandas_udf(first, PREFIX)


def _similar(shared: Broadcast, n: int, weigh: Callable[[int, int], float]):  # noqa: ANN202
    def alike(a: pd.Series, b: pd.Series, whole: pd.Series, threshold: pd.Series) -> pd.Series:
        counts, out = shared.value, []
        for x, y, w, t in zip(a, b, whole, threshold):
            common = sum(weigh(counts[g], n) for g in set(x).intersection(y) if g in counts)
            out.append(common >= t * (w - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(alike, BooleanType())


def similar_sets(
    left: DataFrame, right: DataFrame, threshold: float, weigh: Callable[[int, int], float] = gram_weight, *, stricter: dict[str, float] | None = None
) -> DataFrame:
    """(l, r): all pairs of one block whose gram sets have a weighted Jaccard similarity of ``threshold`` or more.

    Both sides: ``id`` (unique), ``blocks`` (an array) or ``block``, ``grams`` (a set); the right one holds the known names,
    whose q-grams give the weights (``weigh``: of how many of how many names have one).  ``stricter`` names blocks with a
    threshold of their own.  Rows without block or grams pair with nothing.  No pair is lost and none is capped.  A (block,
    q-gram) that holds a large part of the rows is split by the adaptive skew join, which the merge join allows.
    """
    counts = {r.g: r.n for r in right.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) > ALPHABET**3:
        raise ValueError("grams must be 3-grams over letters")
    n, shared = right.count(), left.sparkSession.sparkContext.broadcast(counts)
    first, alike = _prefix(shared, n, weigh), _similar(shared, n, weigh)
    t = F.lit(float(threshold))
    for block, own in (stricter or {}).items():
        t = F.when(F.col("block") == block, F.lit(float(own))).otherwise(t)

    def side(d: DataFrame, name: str) -> DataFrame:
        # Block and gram as one number: half the bytes to shuffle; a chance meeting of two is undone by the check below.
        blocks = F.col("blocks") if "blocks" in d.columns else F.array("block")
        d = d.select(F.col("id").alias(name), F.explode(blocks).alias("block"), "grams").where(F.col("block").isNotNull())
        d = d.withColumn("t", t).withColumn("p", first("grams", "t"))
        d = d.select(name, "t", F.col("p.weight").alias(f"{name}_w"), F.col("block"), F.inline(F.arrays_zip(F.col("p.first").alias("g"), F.col("p.rest").alias(f"{name}_rest"))))
        return d.select(name, "t", f"{name}_w", f"{name}_rest", F.xxhash64("block", "g").alias("key"))

    a, b = side(left, "l"), side(right, "r").drop("t")
    near = (F.col("r_w") >= F.col("l_w") * F.col("t") - 1e-9) & (F.col("l_w") >= F.col("r_w") * F.col("t") - 1e-9)
    # All that two sets share weighs no more than what either has from the rarest q-gram they share on; a pair is kept at that
    # one or not at all, so most meetings on frequent q-grams, which are the most, end here instead of in the shuffle.
    enough = F.least("l_rest", "r_rest") * (1 + F.col("t")) >= F.col("t") * (F.col("l_w") + F.col("r_w")) - 1e-9
    pairs = large_join(a, b, "key").where(near & enough).groupBy("l", "r").agg(F.first(F.col("l_w") + F.col("r_w")).alias("whole"), F.min("t").alias("t"))
    la, rb = left.select(F.col("id").alias("l"), F.col("grams").alias("lg")), right.select(F.col("id").alias("r"), F.col("grams").alias("rg"))
    both = large_join(large_join(pairs, la, "l"), rb, "r")
    return both.where(alike("lg", "rg", "whole", "t")).select("l", "r")


SCORED = "l long, r long, core_score double, kind_score double"


def verify(pairs: DataFrame) -> DataFrame:
    """(l, r, core_score, kind_score) for rows (l, r, a_core, a_kinds, a_phase, b_core, b_kinds, b_phase, weights, place)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            core, kind = [], []
            for x in f.itertuples(index=False):
                core.append(names.soft_score(list(x.a_core), list(x.b_core), list(x.weights), list(x.place)))
                kind.append(names.kind_score(list(x.a_kinds), list(x.b_kinds), x.a_phase, x.b_phase))
            yield pd.DataFrame({"l": f["l"], "r": f["r"], "core_score": core, "kind_score": kind})

    return pairs.mapInPandas(run, SCORED)


@F.pandas_udf(WORDS)
def place_words(text: pd.Series) -> pd.Series:
    """Words of the name of a place."""
    return text.map(lambda t: names.squeeze(t).replace("-", " ").split() if t else [])


def link_variants(
    typed: DataFrame, known: DataFrame, *, threshold: float = 0.12, accept: float = 0.47, margin: float = 0.02
) -> DataFrame:
    """(id, target, score, second): for each typed name the entity it means, where one is clear.

    ``typed``: id (bigint, unique), name, phase, blocks (array<string>); words of a block's commonest place are no part of a
    name.  ``known``: target, name, phase, place, blocks;
    an entity may have several names.  A typed name goes to the entity of its best known name, if that scores ``accept``
    or more and no other entity comes closer than ``margin``.

    Null, empty or word-less names link to nothing, nor do rows without a block.  Repeated known rows count once.  Typed
    names written alike, letter for letter, in the same blocks and phase are compared once.  Empty tables give no links.
    """
    k = known.where(F.col("target").isNotNull() & F.col("name").isNotNull()).select("target", "name", "phase", "place", "blocks").distinct()
    # Numbers given once, when the table is written: unlike hashes, no two names can share one.
    k = k.withColumn("id", F.monotonically_increasing_id()).withColumn("p", parsed("name"))
    k = staged(k.select("id", "target", "phase", "place", "blocks", "p.*").where(F.size("core") > 0), "known")
    k = staged(large_join(k, word_weights(k), "id"), "weighed")
    same = ["name", "phase", "blocks"]
    t = typed.where(F.col("name").isNotNull()).select("id", *same)
    spelt = staged(t.select(*same).distinct().withColumn("key", F.monotonically_increasing_id()), "spellings")
    block_place = k.where("place is not null").select(F.explode("blocks").alias("block"), "place").groupBy("block").agg(F.mode("place", True).alias("place"))
    places = spelt.select("key", F.explode("blocks").alias("block")).join(block_place, "block").groupBy("key").agg(F.max("place").alias("place"))
    one = staged(large_join(spelt, places, "key", "left").withColumn("p", parsed_at("name", "place")).select(F.col("key").alias("id"), "phase", "blocks", "p.*").where(F.size("core") > 0), "typed")
    sets = lambda d: d.select("id", "blocks", "grams")
    pairs = staged(similar_sets(sets(one), sets(k), threshold), "pairs")
    a = one.select(F.col("id").alias("l"), F.col("core").alias("a_core"), F.col("kinds").alias("a_kinds"), F.col("phase").alias("a_phase"))
    b = k.select(
        F.col("id").alias("r"), "target", F.col("core").alias("b_core"), F.col("kinds").alias("b_kinds"), F.col("phase").alias("b_phase"),
        "weights", place_words("place").alias("place"),
    )
    scored = verify(large_join(large_join(pairs, a, "l"), b.drop("target"), "r"))
    total = F.col("core_score") + 0.12 * F.col("kind_score")
    by_target = large_join(scored, b.select("r", "target"), "r").groupBy("l", "target").agg(F.max(total).alias("score"))
    best = _two_best(by_target)
    sure = (F.col("score") >= accept) & (F.coalesce(F.col("second"), F.lit(0.0)) <= F.col("score") - margin)
    told = large_join(spelt, best.where(sure).withColumnRenamed("l", "key"), "key").drop("key").withColumn("_h", F.xxhash64(*same))
    # The hash finds the spelling, the columns themselves decide; nulls are alike.
    meant = large_join(t.withColumn("_h", F.xxhash64(*same)), told.select("_h", *[F.col(c).alias(f"_{c}") for c in same], "target", "score", "second"), "_h")
    for c in same:
        meant = meant.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    return meant.select("id", "target", "score", "second")


def _two_best(by_target: DataFrame) -> DataFrame:
    """(l, target, score, second) of scored targets; equal scores are ordered by the target."""
    top = by_target.groupBy("l").agg(F.max(F.struct("score", "target")).alias("b"))
    rest = large_join(by_target, top, "l").where(F.col("target") != F.col("b.target")).groupBy("l").agg(F.max("score").alias("second"))
    return large_join(top, rest, "l", "left").select("l", "b.target", "b.score", "second")
