import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import mixing as M

TARGETS = [("Big Source", 2.0, 1), ("small", 1.0, 3), ("none", 5.0, 2), ("off", 0.0, 2), (None, 1.0, 1)]


@pytest.fixture(scope="module")
def world(spark):
    rows = [(i, "big_source" if i % 10 else "small", 20 + i * 37 % 400) for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    return texts, spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int")


def test_shares_and_caps(world):
    texts, targets = world
    plan = M.plan_mixture(texts, targets)
    used = M.uses(M.placed(texts, plan, buckets=16)).cache()
    shares = {r.source: r for r in M.reached(used, plan, targets).collect()}
    assert set(shares) == {"big_source", "small", "none"}
    assert shares["none"].used_tokens == 0
    for s in ("big_source", "small"):
        assert abs(shares[s].reached_share - shares[s].target_share) < 0.01
        assert shares[s].most_uses <= shares[s].max_repeats
    assert shares["small"].most_uses == 3  # the source that bounds the mixture is used up
    assert abs(used.agg(F.sum(F.col("uses") * F.col("tokens"))).first()[0] - plan.total) < 0.02 * plan.total


def test_prefixes_follow_the_targets(world):
    texts, targets = world
    plan = M.plan_mixture(texts, targets)
    slots = {r.slot: r.source for r in M.schedule(texts, plan, chunk=100).collect()}
    assert sorted(slots) == list(range(plan.slots))
    n = 0
    for i in range(plan.slots):
        n += slots[i] == "small"
        assert abs(n - plan.share["small"] * (i + 1)) < 4
    ranks = sorted((r["rank"], r.slot) for r in M.schedule(texts, plan, chunk=100).where("source = 'small'").collect())
    assert [r for r, _ in ranks] == list(range(len(ranks)))
    assert [s for _, s in ranks] == sorted(s for _, s in ranks)


def test_same_whatever_the_buckets(world):
    texts, targets = world
    plan = M.plan_mixture(texts, targets)
    one = M.lines(texts.where("source = 'small'"), plan, buckets=8)
    starts = sorted((r.start, r.tokens) for r in one.collect())
    assert starts[0][0] == 0
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))


def test_edges(spark, world):
    _, targets = world
    empty = spark.createDataFrame([], "doc_id long, source string, tokens int")
    plan = M.plan_mixture(empty, targets)
    assert M.uses(M.placed(empty, plan)).collect() == []
    assert all(r.reached_share == 0 for r in M.reached(M.uses(M.placed(empty, plan)), plan, targets).collect())
    copies = spark.createDataFrame([(2, "a", 1, 1, 5), (1, "a", 1, 1, 5), (3, "b", 1, 1, 5)], "doc_id long, source string, h1 long, h2 long, tokens int")
    assert [tuple(r) for r in M.one_text_each(copies).collect()] == [(1, "a", 5)]
    short = spark.createDataFrame([(1, "small", 10), (2, "big_source", 1000)], "doc_id long, source string, tokens int")
    plan = M.plan_mixture(short, targets, total=3000)
    got = {r.source: r for r in M.reached(M.uses(M.placed(short, plan)), plan, targets).collect()}
    assert got["small"].most_uses <= 3
    assert got["big_source"].most_uses == 1
