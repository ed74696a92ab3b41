"""Stored results as a source, and the executor with its store."""

import json

from pyspark.sql import functions as F

from tessera.operators.execution import Executor, canonical, client_backend, table_backend
from tessera.sources.results import read_results, write_results

RESULT = "target string, query string, ok boolean, keys array<string>, rows array<string>, error string, elapsed_s double"


def stored(spark, path: str) -> str:
    rows = [(t, f"q{i}", True, ["n"], [json.dumps([i]), json.dumps([i + 1])], None, 0.5) for t in ("a", "b/ä=1", "c", None) for i in range(10)]
    write_results(spark.createDataFrame([*rows, ("a", "bad", False, None, None, "SyntaxError", 0.0)], RESULT).repartition(2), path)
    return path


def test_only_the_files_of_the_targets_asked_for_are_read(spark, tmp_path):
    path = stored(spark, str(tmp_path / "r"))
    all_rows, some = read_results(spark, path), read_results(spark, path).filter(F.col("target").isin("a", "b/ä=1"))
    files = lambda *names: sum(1 for d in (tmp_path / "r").iterdir() if not names or d.name in names for f in d.glob("part-*.json"))
    assert all_rows.rdd.getNumPartitions() == files() and some.rdd.getNumPartitions() < files()
    one = read_results(spark, path).filter("target = 'c' AND query = 'q3'")
    assert one.rdd.getNumPartitions() == files("target=c") and [r.rows for r in one.collect()] == [["[3]", "[4]"]]
    assert all_rows.count() == 41 and some.count() == 21 and read_results(spark, path).filter("target IS NULL").count() == 10
    assert read_results(spark, path).filter("target = 'none'").count() == 0
    assert sorted({r.target for r in some.collect()}) == ["a", "b/ä=1"]


def test_the_schema_is_inferred(spark, tmp_path):
    mixed = spark.createDataFrame([("a", 1, None, [1]), ("b", None, "x", [2])], "target string, n long, s string, l array<long>")
    write_results(mixed, str(tmp_path / "m"))
    write_results(spark.createDataFrame([("c", 1.5)], "target string, n double"), str(tmp_path / "m"))
    got = read_results(spark, str(tmp_path / "m"), None)
    assert dict(got.dtypes) == {"target": "string", "n": "double", "s": "string", "l": "array<bigint>"}
    assert sorted((r.target, r.n, r.s, r.l) for r in got.collect()) == [("a", 1.0, None, [1]), ("b", None, "x", [2]), ("c", 1.5, None, None)]


def requests(spark, rows):
    return spark.createDataFrame(rows, "target string, kind string, query string")


def test_a_second_run_executes_nothing(spark, tmp_path):
    results = read_results(spark, stored(spark, str(tmp_path / "r")))
    e = Executor(spark, str(tmp_path / "store"), table_backend(results))
    asked = requests(spark, [("a", "run", f"q{i % 4}") for i in range(50)] + [("a", "run", "bad"), ("a", "run", "none"), ("c", "explain", "q1"), ("c", None, " \n"), ("c", "run", None)])
    first = {(r.target, r.kind, r.query): r for r in e.answers(asked).collect()}
    assert e.executed == 7 and len(first) == 9 and not any(r.from_cache for r in first.values())
    assert first["a", "run", "q2"].rows == ["[2]", "[3]"] and first["a", "run", "bad"].error == "SyntaxError" and first["a", "run", "none"].error == "no stored result"
    assert first["c", "explain", "q1"].ok and first["c", "explain", "q1"].rows == [] and {r.error for r in first.values() if r.query.strip() == ""} == {"empty query"}
    again = {(r.target, r.kind, r.query): r for r in e.answers(asked).collect()}
    files = sorted(str(f) for f in (tmp_path / "store").rglob("*.parquet"))
    assert e.executed == 0 and sum(r.from_cache for r in again.values()) == 7 and all(again[k].rows == r.rows and again[k].ok == r.ok for k, r in first.items())
    e.answers(asked.limit(3)).collect()
    assert sorted(str(f) for f in (tmp_path / "store").rglob("*.parquet")) == files
    # one more request runs alone
    e.answers(asked.unionByName(requests(spark, [("c", "run", "q9")]))).collect()
    assert e.executed == 1


def client(log: str, down_calls: int):
    def connect(target: str):
        if target == "locked":
            raise PermissionError("Unauthorized")
        calls = [0]

        def run(query: str):
            with open(log, "a") as f:
                f.write(f"{target}\t{query}\n")
            calls[0] += 1
            if target == "down" or (target == "shaky" and calls[0] <= down_calls):
                raise ConnectionError("Connection refused")
            if query.removeprefix("EXPLAIN ").startswith("bad"):
                raise ValueError("SyntaxError")
            return ["x", "y"], [[1.23456789, {"b": b"\x01", "a": None}], [2, "é"]]

        return run

    return connect


def test_targets_that_are_down_are_asked_three_times_and_nothing_of_it_is_stored(spark, tmp_path):
    log = tmp_path / "log"
    asked = requests(spark, [(t, "run", f"q{i}") for t in ("up", "down", "locked") for i in range(9)] + [("up", "run", "bad"), ("up", "explain", "bad")]).coalesce(1)
    e = Executor(spark, str(tmp_path / "store"), client_backend(client(str(log), 0), retries=1, wait=lambda attempt, connection: None))
    rows = e.answers(asked).collect()
    lines = log.read_text().splitlines()
    assert e.executed == 29 and sum(x.startswith("down") for x in lines) == 3 * 2 and sum(x.startswith("up") for x in lines) == 9 + 2 * 2
    assert sorted({(r.target, r.connection) for r in rows if r.connection}) == [("down", "transient"), ("locked", "fatal")]
    assert next(r.rows for r in rows if r.target == "up" and r.ok) == ['[1.234568, {"a": null, "b": "01"}]', '[2, "é"]']
    assert {(r.ok, r.error) for r in rows if r.query == "bad"} == {(False, "ValueError: SyntaxError")}
    e.answers(asked).collect()
    assert e.executed == 18  # all of the two that were down, and no other


def test_a_success_resets_the_count(spark, tmp_path):
    log = tmp_path / "log"
    asked = requests(spark, [("shaky", "run", f"q{i}") for i in range(12)]).coalesce(1)
    e = Executor(spark, str(tmp_path / "store"), client_backend(client(str(log), 2), retries=0))
    assert sum(r.ok for r in e.answers(asked).collect()) == 10 and len(log.read_text().splitlines()) == 12


def test_comparison(spark, tmp_path):
    rows = [("t", "one", True, ["n"], ["[1]", "[2]"]), ("t", "two", True, ["m"], ["[2]", "[1]"]), ("t", "one ORDER BY n", True, ["n"], ["[1]", "[2]"]), ("t", "bad", False, [], [])]
    table = spark.createDataFrame([(*r, None if r[2] else "SyntaxError", 0.1) for r in rows] + [("u", "one", False, [], [], "ServiceUnavailable", 0.0)], RESULT)
    pairs = [(1, "t", "one", "two"), (2, "t", "one ORDER BY n", "two"), (3, "t", "bad", "one"), (4, "t", "one", "bad"), (5, "t", "one", None), (6, "u", "one", "one"), (7, "t", "one", "one")]
    df = spark.createDataFrame(pairs, "id int, target string, gold_cypher string, predicted_cypher string")
    e = Executor(spark, str(tmp_path / "store"), table_backend(table))
    got = {r.id: r for r in e.compare(df).collect()}
    assert {k: (r.execution_status, r.execution_match) for k, r in got.items()} == {1: ("compared", True), 2: ("compared", False), 3: ("gold_failed", None), 4: ("pred_failed", False), 5: ("pred_failed", False), 6: ("connection_failed", None), 7: ("compared", True)}
    assert got[2].order_sensitive and not got[1].order_sensitive and got[5].pred_error == "empty query" and got[1].gold_row_count == 2
    strict = {r.id: r.execution_match for r in e.compare(df, order_sensitive=False, compare_keys=True).collect()}
    assert strict[1] is False and strict[7] is True and e.executed == 1  # the one that tells of the connection
    valid = {r.query: (r.syntax_valid, r.syntax_error) for r in e.validate(spark.createDataFrame([("t", "one"), ("t", "bad"), ("u", "one2")], "target string, query string")).collect()}
    assert valid == {"one": (True, None), "bad": (False, "SyntaxError"), "one2": (False, "no stored result")}


def test_values_of_any_depth():
    assert canonical([(1, True, None), {2: 0.1234567, "1": float("nan")}, b"\xff", 3 + 4j]) == [[1, True, None], {"1": "nan", "2": 0.123457}, "ff", "(3+4j)"]
