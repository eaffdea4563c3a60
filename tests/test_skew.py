"""Spread plans give the rows of the plain ones; NULL keys, copies and ties included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from harborbook.operators.flows import increments_of_rows
from harborbook.operators.ranges import in_ranges, previous_values, running_total_of_rows
from harborbook.operators.skew import attach_totals, find_hot_keys, fold_copies, salted_join

PARTS = [1, 7, 12, 1000]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(3)
    items = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{pick.randrange(40)}"
        items.append((key, pick.randrange(1, 6), i % 50 if i % 3 == 0 else i, pick.randrange(100)))
    return spark.createDataFrame(items, "k string, t int, id int, v int").cache()


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fan_outs_follow_counts(rows):
    """A third of 600 rows on one key and 57 on NULL: of 12 parts of 50 rows they would fill 4 and 2."""
    hot = find_hot_keys(rows, {"k": ["k"], "id": ["id"]}, 12)
    fans = rows.groupBy("k").count().select("k", "count", F.xxhash64("k").alias("_hash")).join(hot["k"].fans, "_hash")
    assert {r["k"]: (r["count"], r["_fan"]) for r in fans.collect()} == {"hot": (200, 4), None: (57, 2)}
    assert hot["id"].fans.count() == 0
    assert find_hot_keys(rows, {"k": ["k"]}, 1)["k"].fans.count() == 0
    assert find_hot_keys(rows.limit(0), {"k": ["k"]}, 12)["k"].fans.count() == 0


def test_hot_keys_are_fewer_than_parts(spark):
    many = spark.range(1200).selectExpr("id % 400 AS k")
    for parts in (10, 399, 400, 401, 5000):
        fans = [r["_fan"] for r in find_hot_keys(many, {"k": ["k"]}, parts)["k"].fans.collect()]
        assert len(fans) == (400 if parts > 400 else 0) and sum(fans) < 2 * parts


def test_nothing_runs_while_a_plan_is_built(spark, rows):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    attach_totals(rows, "k", {"s": F.sum("v")}).join(salted_join(rows, rows.select("k").distinct(), "k"), "k")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


@pytest.mark.parametrize("parts", PARTS)
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join(spark, rows, parts, how, null_safe):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("unmatched", 5)], "k string, w int")
    hot = find_hot_keys(rows, {"k": ["k"]}, parts)["k"]
    match = rows.k.eqNullSafe(right.k) if null_safe else rows.k == right.k
    want = rows.join(right, match, how).select(rows.k, "t", "id", "v", "w")
    got = salted_join(rows, right, "k", how, hot=hot, null_safe=null_safe).select("k", "t", "id", "v", "w")
    assert listed(got) == listed(want)


def test_salted_join_deals_a_hot_key_over_several_tasks(spark, rows):
    """Rows of the hot key lie in as many places as it has sub-keys, near enough in equal shares."""
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    hot = find_hot_keys(numbered, {"k": ["k"]}, 12)["k"]
    salted = hot.salted(numbered, ["k"], F.pmod(F.xxhash64("n"), F.col("_fan")), "salt").where("k = 'hot'")
    shares = [r["count"] for r in salted.groupBy("salt").count().collect()]
    assert len(shares) == 4 and max(shares) < 80


def test_salted_join_with_a_map_beside_the_key(spark, rows):
    mapped = rows.withColumn("m", F.create_map(F.lit("a"), "v"))
    got = salted_join(mapped, rows.select("k").distinct().withColumn("w", F.lit(1)), "k")
    assert got.count() == 600 and got.where("w = 1").count() == rows.where("k IS NOT NULL").count()


@pytest.mark.parametrize("parts", PARTS)
def test_attach_totals(rows, parts):
    window = Window.partitionBy("k", "t")
    totals = {"s": F.sum("v"), "n": F.count("id"), "m": F.min("t")}
    want = listed(rows.select("*", *[c.over(window).alias(n) for n, c in totals.items()]))
    hot = find_hot_keys(rows, {"k": ["k"]}, parts)["k"]
    assert listed(attach_totals(rows, ["k", "t"], totals, hot, ["k"])) == want
    assert listed(attach_totals(rows, ["k", "t"], totals)) == want
    assert listed(attach_totals(rows.select("*"), ["k", "t"], totals, of=rows)) == want
    assert attach_totals(rows.limit(0), "k", totals).count() == 0


def test_fold_copies(rows):
    folded = fold_copies(rows.union(rows))
    assert folded.agg(F.sum("copies")).first()[0] == 1200
    assert folded.count() == rows.distinct().count()


def test_row_increments(rows):
    """Each row is compared with the one before it, however many rows a key or a period has."""
    unique = rows.withColumn("id", F.xxhash64("k", "t", "id", "v", F.monotonically_increasing_id())).cache()
    before = F.lag("v").over(Window.partitionBy("k").orderBy("t", "id"))
    want = unique.select("*", F.coalesce(F.col("v") - before, "v").alias("inc"))
    assert listed(increments_of_rows(unique, "k", "t", ["id"], {"v": "inc"})) == listed(want)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_ranges_hand_on_what_stood_before(spark, rows, parts):
    """Windows over keys of which one has a third of the rows, cut into any number of ranges; NULL keys and values too."""
    given = rows.select("k", "t", F.when(F.col("v") > 20, F.col("v")).alias("v"), F.monotonically_increasing_id().alias("id")).cache()
    window = Window.partitionBy("k").orderBy("t", "id")
    want = given.select("*", F.lag("v").over(window).alias("p"), F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = previous_values(given, "k", ["t", "id"], ["v"]).select("k", "t", "v", "id", F.col("_prior.v").alias("p"))
        assert listed(got) == listed(want.drop("s"))
        got = running_total_of_rows(given, "k", ["t", "id"], {"v": "s"})
        assert got.schema["s"].dataType == want.schema["s"].dataType
        assert listed(got) == listed(want.drop("p"))
        assert running_total_of_rows(given.limit(0), "k", ["t", "id"], {"v": "s"}).count() == 0
        # Only the ends of ranges travel: no part holds much more than its share.
        if parts == 37:
            sizes = [r["count"] for r in in_ranges(given, ["k"], ["t", "id"]).groupBy("_part").count().collect()]
            assert len(sizes) > 20 and max(sizes) < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
