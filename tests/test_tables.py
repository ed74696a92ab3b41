from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import tables as T
from tessera.operators.generation import generate
from tessera.sources import records as R
from tessera.streaming.guards import append_log, drain, failure_guard, file_stream


def test_three_denominators(spark):
    rows = [("compared", True, True, True), ("pred_failed", False, True, False), ("gold_failed", None, False, True), ("connection_failed", None, None, None), (None, None, None, None)]
    d = spark.createDataFrame(rows, "execution_status string, execution_match boolean, gold_executed_ok boolean, pred_executed_ok boolean")
    d = R.with_defaults(d, R.SCORED).withColumns({"overlap": F.lit(1), "n_pred": F.lit(2), "n_gold": F.lit(2), "predicted_cypher": F.lit("x")})
    s = E.summarise(d).first()
    assert s.n == 5 and s.n_executed == 3 and s.n_connection_failed == 1 and s.n_gold_failed == 1
    assert round(s.execution_accuracy, 4) == 0.3333 and s.execution_accuracy_gold_ok == 0.5 and s.execution_accuracy_judged == 0.5
    assert s.syntax_valid_rate is None and s.prompt_tokens_p95 is None


def test_retention(spark):
    d = spark.createDataFrame([("r", s) for s in (50, 100, 150, 160)], "run string, step int")
    kept = {r.step for r in T.retention(d, "run", "step", F.col("step") != 160, 2).collect() if r.kept}
    assert kept == {100, 150, 160}


def test_replays(spark):
    d = spark.createDataFrame([(1, 0, 5.0, 1, "state"), (1, 1, 9.0, 2, "late"), (2, 1, 3.0, 3, "early"), (2, 1, 4.0, 4, "late")], "step int, priority int, time double, id int, name string")
    assert {r.step: r.name for r in T.latest_events(d, ["step"], F.col("priority"), "time", "id").collect()} == {1: "state", 2: "late"}


def test_split_and_sample(spark):
    d = spark.range(100)
    s = T.split(d, "id", 0.1, 500, 7)
    assert s.filter("split = 'val'").count() == 10 and T.split(d, "id", 0, 5, 7).filter("split = 'val'").count() == 0
    assert T.split(d, "id", 0.001, 500, 7).filter("split = 'val'").count() == 1
    d = d.withColumn("s", F.when(F.col("id") < 70, "a").otherwise("b"))
    assert {r.s: r["count"] for r in T.stratified(d, "id", "s", 25, 1).groupBy("s").count().collect()} == {"a": 18, "b": 7}


def test_results_are_multisets(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "g int, x int")
    b = spark.createDataFrame([(1, 2), (1, 1)], "g int, x int")
    assert not T.same_results(a, b, ["g"], [F.col("x")]).first().same
    assert T.same_results(a, a.orderBy(F.desc("x")), ["g"], [F.col("x")]).first().same


def test_dead_groups(spark):
    d = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), (None, True)], "db string, bad boolean")
    assert {r.db: r.dead_database for r in T.flag_dead(d, "db", F.col("bad")).collect()} == {"a": True, "b": False, None: True}


def test_corpus_defaults(spark, tmp_path):
    spark.createDataFrame([("q", "", "db1", None), ("r", "id7", "", "src")], "question string, instance_id string, database_reference string, data_source string").coalesce(1).write.parquet(str(tmp_path / "test.parquet"))
    got = {r.question: r for r in R.read_corpus(spark, str(tmp_path), "test").collect()}
    assert got["q"].instance_id == "test_0" and got["q"].database_reference == "db1" and got["q"].data_source == "unknown"
    assert got["r"].instance_id == "id7" and got["r"].database_reference is None


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, [1, 2], None)], "a int, b array<int>, c string")
    for kind in ("parquet", "csv", "csv.gz"):
        R.write_table(d, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "[1,2]"
    R.write_lines(d, str(tmp_path / "l"))
    assert R.read_lines(spark, str(tmp_path / "l"), "a int, b array<int>, c string").first() == d.first()
    assert R.report_document({"t": d}) == '{"t": [{"a": 1, "b": [1, 2]}]}'
    assert R.markdown(d).endswith("| 1 | [1, 2] | - |") and "tabular" in R.latex(d)


def test_generation(spark):
    d = spark.createDataFrame([(1, "find name:"), (2, None)], "id int, prompt string")
    assert {r.id: r.predicted_cypher for r in generate(d).collect()} == {1: "MATCH (n) RETURN n.name", 2: "MATCH (n) RETURN n.x"}


def test_guard_fires_once_a_run(spark, tmp_path):
    rows = [("u", i, b) for i, b in enumerate([True, True, False, True, True, True, True, False, True, True, True])]
    spark.createDataFrame(rows, "k string, i long, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = file_stream(spark, str(tmp_path / "in"), "k string, i long, bad boolean")
    got = drain(failure_guard(s, "k", "i", "bad", 3), "guard_once", str(tmp_path / "cp")).orderBy("at").collect()
    assert [(r.at, r.run) for r in got] == [(5, 3), (10, 3)]
    append_log(s, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 11


def test_results_are_compared_value_by_value(spark):
    pair = lambda *r: spark.createDataFrame(list(r), "g int, x string, y string")
    same = lambda a, b, **k: T.same_results(a, b, ["g"], ["x", "y"], **k).first().same
    assert not same(pair((1, "a|b", "c")), pair((1, "a", "b|c"))) and not same(pair((1, None, "c")), pair((1, "c", None))) and not same(pair((1, None, "c")), pair((1, "", "c")))
    assert same(pair((1, "a", "c"), (1, "b", None)), pair((1, "b", None), (1, "a", "c"))) and not same(pair((1, "a", "c"), (1, "a", "c")), pair((1, "a", "c")))
    a, b = pair((1, "a", "c")), pair((1, "a", "c")).toDF("g", "x", "z")
    assert same(a, b, theirs=["x", "z"]) and not same(a, b, theirs=["x", "z"], compare_keys=True)
    o = lambda *r: spark.createDataFrame(list(r), "g int, x string, y string, p int")
    assert same(o((1, "a", "", 1), (1, "b", "", 2)), o((1, "b", "", 1), (1, "a", "", 2))) and not same(o((1, "a", "", 1), (1, "b", "", 2)), o((1, "b", "", 1), (1, "a", "", 2)), order=["p"])


def test_deep_values_are_normalised(spark):
    kind = "g int, v struct<b: double, a: array<double>>, m map<int, double>, h binary"
    a = spark.createDataFrame([(1, (0.12345678, [1.0000001]), {2: 0.1, 1: 0.3}, bytearray(b"\x0a"))], kind)
    b = spark.createDataFrame([(1, (0.1234569, [1.0]), {1: 0.3, 2: 0.1}, bytearray(b"\x0a"))], kind)
    assert T.same_results(a, b, ["g"], ["v", "m", "h"]).first().same
    signs = [T.result_signature(t, ["g"], ["v", "m", "h"]).first().signature for t in (a, b, b.union(b), b.withColumn("h", F.lit(None).cast("binary")))]
    assert signs[0] == signs[1] and len(set(signs)) == 3


def test_health_of_odd_groups(spark):
    rows = [("a", True, "x" * 400), ("a", None, ""), ("", True, None), (None, False, None), ("c", True, "e"), ("d", False, None)]
    d = spark.createDataFrame([(*r, r[0] != "c") for r in rows], "db string, bad boolean, error string, ran boolean")
    got = {r.db: (r.executed, r.failed, r.dead, r.top_errors) for r in T.gold_health(d, "db", F.col("bad"), F.col("error"), F.coalesce("ran", F.lit(True))).collect()}
    assert got == {"a": (2, 2, True, "unknown:1; " + "x" * 300 + ":1"), "(none)": (2, 1, False, "unknown:1")}
    flags = [(r.db, r.dead_database) for r in T.flag_dead(d, "db", F.col("bad"), F.col("db") != "c").collect()]
    assert sorted(flags, key=str) == sorted([("a", True), ("a", True), ("", True), (None, None), ("c", None), ("d", False)], key=str)


def test_mirror_tries_again_and_partial_lines_are_carried(spark, tmp_path):
    from tessera.streaming.guards import carried, mirror

    spark.range(5).write.parquet(str(tmp_path / "in"))
    s, got = file_stream(spark, str(tmp_path / "in"), "id long", 100), []

    def write(part):
        got.append(part.count())
        if len(got) < 3:
            raise OSError("busy")

    mirror(s, write, str(tmp_path / "state")).awaitTermination()
    assert got == [5, 5, 5]
    lines, rest = carried("", "a\r1%\r2%\nb\n50%\r6")
    assert (lines, rest) == (["2%", "b"], "50%\r6")
    assert carried(rest, "0%\nend") == (["60%"], "end")


def test_reports_are_never_cut(spark):
    import pytest

    d = spark.range(5).withColumn("x_y", F.lit(None).cast("double"))
    assert R.markdown(d.limit(1)) == "| id | x_y |\n| --- | --- |\n| 0 | - |" and r"x\_y" in R.latex(d)
    assert "## none" not in R.markdown_report({"All": d, "Empty": d.limit(0)}) and "## Empty\n\nnone" in R.markdown_report({"All": d, "Empty": d.limit(0)})
    for f in (R.markdown, R.latex):
        with pytest.raises(ValueError):
            f(d, 4)
