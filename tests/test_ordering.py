"""Ordering blocks: same result for any partitioning, hot keys included."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline import ordering as o


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows; key 0 holds a third of them."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(6000).select(
        key.alias("k"), (F.col("id") * 7919 % 6000).alias("p"), (F.xxhash64("id") % 100).alias("v")
    ).cache()


def test_first_and_last_per_key(skewed):
    w = Window.partitionBy("k")
    for fn, order in ((o.first_per_key, F.asc("p")), (o.last_per_key, F.desc("p"))):
        want = skewed.withColumn("r", F.row_number().over(w.orderBy(order))).filter("r = 1").drop("r")
        assert rows(fn(skewed, ["k"], ["p"])) == rows(want)


def test_first_per_key_keeps_nulls(frame):
    df = frame("k string, o int, v string", ("a", 1, None), ("a", 2, "x"), (None, 1, "n"), (None, 0, "m"))
    assert rows(o.first_per_key(df, ["k"], ["o"])) == [(None, 0, "m"), ("a", 1, None)]


def test_last_per_key_with_a_map(frame):
    df = frame("k string, o int, v map<string,int>", ("a", 1, {"x": 1}), ("a", 2, {"x": 2}))
    assert o.last_per_key(df, ["k"], ["o"]).first()["v"] == {"x": 2}


@pytest.mark.parametrize("parts", [1, 8])
def test_add_index(skewed, parts):
    order = [F.desc("v"), F.asc("p")]
    got = o.add_index(skewed.repartition(parts), order, 0, "i")
    want = skewed.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1)
    assert rows(got) == rows(want)


def test_add_index_of_nothing(skewed):
    assert o.add_index(skewed.limit(0), ["p"]).count() == 0


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_index_by_hash(skewed, buckets):
    hashed = F.shiftrightunsigned(F.xxhash64("p"), 4)
    got = o.index_by_hash(skewed, hashed, ["p"], 60, buckets)
    order = Window.orderBy(hashed, "p")
    want = skewed.withColumn("index", F.row_number().over(order) - 1)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("block", [1, 64, 1 << 16])
def test_with_previous(skewed, block):
    got = o.with_previous(skewed, ["k"], "p", "v", block=block)
    want = skewed.withColumn("previous", F.lag("v").over(Window.partitionBy("k").orderBy("p")))
    assert rows(got) == rows(want)


def test_with_previous_null_key_and_no_key(frame):
    df = frame("k string, p int, v int", (None, 1, 5), (None, 200, 6), ("a", 3, 7))
    assert rows(o.with_previous(df, ["k"], "p", "v", block=10), "p", "previous") == [(1, None), (200, 5), (3, None)]
    assert rows(o.with_previous(df, [], "p", "v", block=10), "p", "previous") == [(1, None), (200, 7), (3, 5)]


@pytest.mark.parametrize("block", [1, 64, 300, 100_000])
@pytest.mark.parametrize("order", ["p", "v"])
def test_ordered_groups_hold_everything(skewed, block, order):
    """Also where the order column has many ties; segments count from 0 at every size."""
    item = F.struct("v", "p")
    got = o.ordered_groups(skewed, ["k"], [order], item, block=block).collect()
    assert max(len(r["items"]) for r in got) <= block
    joined = {}
    for r in sorted(got, key=lambda r: (r["k"], r["segment"])):
        joined.setdefault(r["k"], []).extend(tuple(x) for x in r["items"])
    want = {}
    for r in skewed.orderBy("k", order, "v", "p").collect():
        want.setdefault(r["k"], []).append((r["v"], r["p"]))
    assert joined == want
    for k, items in want.items():
        assert sorted(r["segment"] for r in got if r["k"] == k) == list(range(-(-len(items) // block)))


@pytest.mark.parametrize("n", [1, 4, 5, 8, 41])
def test_ordered_groups_around_a_block(frame, n):
    df = frame("k string, p int", *[("a", i) for i in range(n)])
    got = o.ordered_groups(df, ["k"], ["p"], F.col("p"), block=4)
    assert rows(got, "segment", "items") == rows(frame("segment bigint, items array<int>", *[(b, list(range(4 * b, min(n, 4 * b + 4)))) for b in range(-(-n // 4))]))


def test_ordered_groups_wanted_and_null_key(frame):
    df = frame("k string, c string, p int", *[(k, c, p) for k in ("a", None) for c in "BA" for p in range(5)], ("z", "A", 1))
    label = F.concat("c", F.col("p").cast("string"))
    whole = o.ordered_groups(df, ["k"], ["c", "p"], label, F.col("p") > 2)
    assert rows(whole) == [
        (None, 0, ["A3", "A4", "B3", "B4"]), ("a", 0, ["A3", "A4", "B3", "B4"]), ("z", 0, []),
    ]
    split = o.ordered_groups(df, ["k"], ["c", "p"], label, F.col("p") > 2, block=3)
    assert rows(split) == [
        (None, 0, ["A3", "A4", "B3"]), (None, 1, ["B4"]), ("a", 0, ["A3", "A4", "B3"]), ("a", 1, ["B4"]), ("z", 0, []),
    ]


def test_top_k(skewed):
    order = [F.desc("v"), F.asc("p")]
    got = o.top_k_per_group(skewed, ["k"], order, 3)
    assert got.count() == 3 * skewed.select("k").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # cut before the shuffle as well
    many = o.top_k_per_group(skewed.repartition(6), ["k"], order, 1500)
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert rows(many) == rows(want.filter("rank <= 1500"))
    best = o.top_k(skewed, order, 5)
    assert [r["rank"] for r in best.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
