import json
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

import tidemark as tm


def test_vectors_and_back(spark):
    rows = [("a", i, i * i) for i in range(9, -1, -1)] + [("b", 0, 7), (None, 3, 1)]
    df = spark.createDataFrame(rows, "key string, x int, y int").repartition(4)
    vectors = tm.series_to_vectors(df, ["y", "x"], "x", "key")
    found = {r.key: (r.x, r.y) for r in vectors.collect()}
    assert found["a"] == (list(range(10)), [i * i for i in range(10)])
    back = tm.vectors_to_rows(vectors, ["x", "y"], "key")
    assert sorted(tuples(back), key=str) == sorted(rows, key=str)


def test_record_map(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    assert df.select(tm.record_map(["a", "b", "c"]).alias("m")).first().m == {"a": "1", "b": "x", "c": None}


def test_first_wins_matches_a_loop(spark):
    rnd = random.Random(0)
    rows = [(0 if i % 3 == 0 else rnd.randrange(20), rnd.choice("abcde"), i, rnd.random()) for i in range(3000)]
    want = {}
    for entity, key, _, value in rows:
        want.setdefault((entity, key), value)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "entity int, key string, t int, value double")
    got = tm.first_wins(df, "entity", "key", "value", "t")
    assert {(r.entity, r.key): r.value for r in got.collect()} == want
    maps = {r.entity: r.record for r in tm.collapse_to_map(got, "entity", "key", "value").collect()}
    assert maps[0] == {k: v for (e, k), v in want.items() if e == 0}


def test_first_wins_strictness(spark):
    schema = "entity int, key string, t int, value string"
    twice = spark.createDataFrame([(1, "a", 2, "late"), (1, "a", 1, None)], schema)
    assert tuples(tm.first_wins(twice, "entity", "key", "value", ["t"])) == [(1, "a", None)]
    with pytest.raises(Exception, match="duplicate key"):
        tm.first_wins(twice, "entity", "key", "value", "t", allow_duplicate_key=False).collect()
    for bad in ("", None):
        df = spark.createDataFrame([(1, bad, 1, "v")], schema)
        with pytest.raises(Exception, match="empty or null key"):
            tm.first_wins(df, "entity", "key", "value", "t").collect()
        loose = tm.first_wins(df, "entity", "key", "value", "t", allow_empty_key=True)
        assert tuples(loose) == [(1, bad, "v")]


@pytest.mark.parametrize("order", ["t", ["t", "u"]])
def test_null_order_fails(spark, order):
    df = spark.createDataFrame([(1, "a", None, 1, "first"), (1, "a", 2, 1, "x")], "entity int, key string, t int, u int, value string")
    with pytest.raises(Exception, match="null order in t"):
        tm.first_wins(df, "entity", "key", "value", order).collect()


def test_repeated_keys_and_unreadable_texts(spark):
    texts = ['{"k": 1, "k": "x"}', "{bad", "[1]", None, '{"k": 2}', ""]
    df = spark.createDataFrame([(t,) for t in texts], "props string")
    got = {(r.key, r.kind): r.n_rows for r in tm.key_profile(df, "props").collect()}
    assert got == {("k", "string"): 1, ("k", "number"): 1}
    assert tuples(tm.json_quality(df, "props")) == [(6, 1, 2, 1)]


def test_strict_cast(spark):
    df = spark.createDataFrame([(True, 3, "x", 1.5)], "b boolean, n bigint, s string, d double")
    out = tm.strict_cast(df, {"b": "number", "n": "number", "s": "string", "d": "number"})
    assert tuples(out) == [(1.0, 3.0, "x", 1.5)]
    assert tuples(tm.strict_cast(df, {"b": "boolean"}).select("b")) == [(True,)]
    for name, kind in (("s", "number"), ("n", "boolean"), ("n", "string"), ("s", "boolean")):
        with pytest.raises(TypeError, match=f"cannot convert {name}"):
            tm.strict_cast(df, {name: kind})
    with pytest.raises(ValueError, match="unknown kind"):
        tm.strict_cast(df, {"n": "date"})
    with pytest.raises(Exception, match="cannot convert a value of n"):
        tm.strict_cast(df.withColumn("n", F.lit(None).cast("bigint")), {"n": "number"}).collect()
    with pytest.raises(Exception, match="cannot convert a value of n"):
        tm.strict_cast(df.withColumn("n", F.lit(2**53 + 1)), {"n": "number"}).collect()


def test_key_profile_matches_a_loop(spark):
    rnd = random.Random(5)
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    values = [1, 2.5, "69", True, None, {}, {"a": 1, "b": {"c": 2}}, [], [1, [2]], "x"]
    docs = [{rnd.choice("kqz"): rnd.choice(values) for _ in range(3)} for _ in range(400)]
    texts = [json.dumps(doc) for doc in docs] + ["not json", "[1, 2]", "7", None]
    want = {}
    for doc in docs:
        for key, value in doc.items():
            kind = kinds.get(type(value), "number")
            size = len(value) if kind in ("object", "array") else None
            n, lo, hi = want.get((key, kind), (0, None, None))
            if size is not None:
                lo, hi = (size, size) if lo is None else (min(lo, size), max(hi, size))
            want[(key, kind)] = (n + 1, lo, hi)
    df = spark.createDataFrame([(text,) for text in texts], "props string")
    got = {(r.key, r.kind): (r.n_rows, r.min_size, r.max_size) for r in tm.key_profile(df, "props").collect()}
    assert got == want
