from pyspark.sql import functions as F

from tessera.operators import analysis as A


def test_features(spark):
    rows = [("how many?", "s", "RETURN 1"), ("q", "s", ""), ("q", "s", "a " * 200), ("long " * 300, "s", "RETURN 1")]
    d = spark.createDataFrame(rows, "question string, schema_text string, target string")
    got = A.features(d, 180).orderBy("question").collect()
    assert len(got) == 2
    for r in got:
        assert len(r.input_ids) == len(r.labels) <= 180 and [x for x in r.labels if x != -100] == r.input_ids[-2:]
    assert [r.over_budget for r in got] == [False, True]


def test_small_tables(spark):
    d = spark.createDataFrame([("a", "1.5", 2, 5), ("a", "x", 1, 4), ("b", None, 3, 3)], "k string, v string, c int, m int")
    assert [r.v for r in A.numeric(d, ["v"]).collect()] == [1.5, None, None]
    assert {r.k: (r.c, r.cost) for r in A.cheapest(d, ["k"], "c", F.col("m")).collect()} == {"a": (1, 4), "b": (3, 3)}
    assert [(r.k, r.c) for r in A.reindexed(d.filter("c > 1"), "k", ["b", "z", "a"]).collect()] == [("b", 3), ("z", None), ("a", 2)]
    assert {r.k: r.diff_counts for r in A.difference_counts(d, ["k"], "c", "m").collect()} == {"a": '{"3":2}', "b": '{"0":1}'}
