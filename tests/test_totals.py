import random
from decimal import Decimal

import pytest
from conftest import tuples
from pyspark.sql import functions as F

import tidemark as tm


def rows_of(seed, n=2000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None])
        name = None if rnd.random() < 0.02 else f"{rnd.randrange(50):02d}"
        out.append((i, key, name, None if rnd.random() < 0.05 else rnd.randrange(-5, 20)))
    return out


def expected(rows, keyed):
    """Running sums by a sorted loop, nulls last."""
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    sums, out = {}, {}
    for i, key, _, value in order:
        group = key if keyed else 0
        if value is not None:
            sums[group] = sums.get(group, 0) + value
        out[i] = sums.get(group)
    return out


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize(("buckets", "parts"), [(1, 3), (7, 5), (64, 2), (None, 9)])
def test_matches_a_sorted_loop(spark, keyed, buckets, parts):
    rows = rows_of(buckets or 0)
    df = spark.createDataFrame(rows, "id bigint, key string, name string, value bigint").repartition(parts)
    out = tm.running_total_rows(df, "value", ["name", "id"], "key" if keyed else None, buckets=buckets)
    assert out.columns == ["id", "key", "name", "value", "running_total"]
    assert {row.id: row.running_total for row in out.collect()} == expected(rows, keyed)


@pytest.mark.parametrize("keyed", [False, True])
def test_peers_share_the_total_of_their_tie(spark, keyed):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id bigint, key string, name string, value bigint").repartition(5)
    out = tm.running_total_rows(df, "value", "name", "key" if keyed else None, buckets=9, peers=True)
    got = out.collect()
    assert len(got) == len(rows)
    rank = lambda name: (name is None, name or "")
    for row in got[:300]:
        before = [
            v
            for _, key, name, v in rows
            if v is not None and rank(name) <= rank(row.name) and (not keyed or key == row.key)
        ]
        assert row.running_total == (sum(before) if before else None)


def test_more_buckets_than_rows_and_no_rows(spark):
    df = spark.createDataFrame([(2, 10), (1, 5)], "id int, value int")
    out = tm.running_total_rows(df, "value", "id", buckets=32)
    assert sorted(tuples(out)) == [(1, 5, 5), (2, 10, 15)]
    assert tuples(tm.running_total_rows(df.where("id > 9"), "value", "id", buckets=32)) == []


def test_decimals_stay_exact(spark):
    df = spark.range(500).select("id", (F.col("id") / 100).cast("decimal(10,2)").alias("value"))
    out = tm.running_total_rows(df, "value", "id", buckets=8)
    last = out.where("id = 499").first().running_total
    assert last == sum(Decimal(i) / 100 for i in range(500))


def test_a_hot_key_is_spread_over_buckets(spark):
    from tidemark.operators.totals import _split_points, _with_bucket

    df = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    placed = _with_bucket(df, ["key", "id"], _split_points(df, ["key", "id"], 16), 16)
    sizes = [row["count"] for row in placed.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 20000
    assert max(sizes) < 3 * 20000 / 16


def test_bucket_follows_the_order(spark):
    from tidemark.operators.totals import _split_points, _with_bucket

    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id"))
    placed = _with_bucket(df, ["id"], _split_points(df, ["id"], 10), 10)
    buckets = [row._bucket for row in placed.orderBy("id").collect()]
    assert buckets == sorted(buckets)
    assert set(buckets) == set(range(11))


@pytest.mark.parametrize("parts", [1, 40])
def test_buckets_are_even_whatever_the_partitions(spark, parts):
    from tidemark.operators.totals import _split_points, _with_bucket

    df = spark.range(200_000).select(F.expr("id * id").alias("id")).repartition(parts)
    placed = _with_bucket(df, ["id"], _split_points(df, ["id"], 8), 8)
    sizes = [row["count"] for row in placed.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) == 9
    assert max(sizes) < 2 * 200_000 / 9


def test_sample_is_bounded_by_the_buckets(spark):
    from tidemark.operators import totals

    df = spark.range(500_000).repartition(3)
    plan = spark.range(1).select(totals._split_points(df, ["id"], 4).alias("cuts"))
    cuts = plan.first().cuts
    assert 1 <= len(cuts) <= 4 and cuts == sorted(cuts)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
