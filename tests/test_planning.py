"""Orders over whole tables, similar elements, plans of jobs, resume choice, manifests and counters, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis as A
from tessera.operators import planning as P
from tessera.operators import similarity
from tessera.operators.ordering import in_order, length_batches, padding
from tessera.operators.schema import apply_mode
from tessera.operators.tables import admitted
from tessera.sources.manifest import manifest, tree_digest


def test_places_and_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 2, 7]), rng.choice([None, 0.5, 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b double").repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    ints = {r.id: (r["rank"], r.running) for r in in_order(df, [F.col("a").asc_nulls_first(), F.col("id").desc()], F.col("a")).collect()}
    halves = {r.id: r.running for r in in_order(df, [F.col("a").asc_nulls_first(), F.col("id").desc()], F.col("b")).collect()}
    total, half = 0, 0.0
    for k, (i, a, b) in enumerate(order):
        total, half = total + (a or 0), half + (b or 0)
        assert ints[i] == (k + 1, total) and halves[i] == half
    assert in_order(df.limit(0), [F.col("id")], F.col("a")).count() == 0


def test_batches_by_length(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 3, 10, 40, 41])) for i in range(400)]
    got = length_batches(spark.createDataFrame(rows, "id int, n int").repartition(3), "n", 100, [F.col("id")])
    total, want = 0, {}
    for i, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += n or 0
        want[i] = max(0, total - 1) // 100
    assert {r.id: r.batch for r in got.collect()} == want and got.columns == ["id", "n", "batch"]
    pads = padding(got, "batch", "n").collect()
    assert sum(r.n for r in pads) == 400 and all(r.n * r.longest - r.padding <= 100 + 41 for r in pads)


def test_admission_by_group(spark):
    rows = [(g, k, c) for g in ("x", None, "y") for k, c in enumerate([5, 1, 9, 2])]
    got = {(r.g, r.k): r.running_cost for r in admitted(spark.createDataFrame(rows, "g string, k int, c long"), ["g"], ["k"], "c", 15).collect()}
    assert got == {(g, k): s for g in ("x", None, "y") for k, s in enumerate([5, 6, 15])}


@pytest.mark.parametrize("block", [4, 512])
def test_similar_vectors_against_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = np.random.default_rng(3)
    q = [(i, "hot" if i % 3 else f"g{i % 5}", [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    e = [(g, f"e{k}", [float(x) for x in rng.normal(size=6)]) for g in ("hot", "g0", "g3", "none") for k in range(7)]
    odd_q = [(200, "hot", None), (201, "hot", [0.0] * 6), (202, "hot", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, "hot", [float("nan")] * 6), (204, "hot", [1.0, 2.0]), (205, None, [1.0] * 6), (206, "hot", [])]
    odd_e = [("hot", "bad", [float("inf")] * 6), ("hot", "short", [1.0] * 3), (None, "null", [1.0] * 6)]
    qs, es = spark.createDataFrame(q + odd_q, "question int, group string, vector array<double>"), spark.createDataFrame(e + odd_e, "group string, element string, vector array<double>")
    want = {}
    for i, g, a in q:
        for h, name, b in e:
            s = np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
            if g == h and s >= 0.3:
                want[i, name] = round(s, 9)
    assert {(r.question, r.element): round(r.score, 9) for r in similarity.similar(qs, es, 0.3).collect()} == want and want


SCHEMA = "Node properties:\n- **Film**\n  - `title`: STRING\n  - `year`: INTEGER\n- **Actor**\n  - `name`: STRING\n- **Studio**\n  - `city`: STRING\nRelationship properties:\n- **PLAYED**\n  - `role`: STRING\nThe relationships:\n(:Actor)-[:PLAYED]->(:Film)\n(:Studio)-[:MADE]->(:Film)"


def test_schemas_pruned_by_vectors(spark):
    """Vectors on the axes, so that it is plain what is similar; the same as by a map of scores."""
    axis = lambda *k: [1.0 if i in k else 0.0 for i in range(8)]
    vectors = {"Film": axis(0), "Film title": axis(1), "Film year": axis(2), "Actor": axis(3), "Actor name": axis(4), "Studio": axis(5), "Studio city": axis(6), "PLAYED": axis(7)}
    asked = {1: axis(1), 2: axis(0, 4), 3: axis(7), 4: axis(6), 5: None, 6: axis(2, 5), 7: [0.0] * 8}
    keys = {n: f"{'rel' if n.startswith('PLAYED') else 'node'}{'_prop' if ' ' in n else ''}|{n.split()[0]}|{n.split()[-1]}" for n in vectors}
    rows = [(k, SCHEMA, "q", v, {keys[n]: float(np.dot(v, w) / np.linalg.norm(v)) for n, w in vectors.items()} if v and any(v) else {}) for k, v in asked.items()] + [(8, "no schema", "q", axis(0), {}), (9, None, "q", axis(0), {})]
    df = spark.createDataFrame(rows, "id int, schema_text string, question string, vector array<double>, scores map<string,double>")
    table = spark.createDataFrame(list(vectors.items()), "name string, vector array<double>")
    got = {r.id: r.pruned for r in similarity.prune_by_vectors(df, "id", "schema_text", "vector", table, "pruned").collect()}
    want = {r.id: r.pruned for r in apply_mode(df, "schema_text", "question", "similarity", "pruned", scores="scores").collect()}
    assert got == want
    assert "`title`" in got[1] and "`year`" not in got[1] and "Actor" not in got[1]
    # a whole node stays whole, and a property alone begins a partial one
    assert "`year`" in got[2] and "`name`" in got[2] and "Studio" not in got[2] and "PLAYED" in got[2]
    # the ends of a kept type's patterns come whole; without a vector the schema stays
    assert "- **Film**" in got[3] and "- **Actor**" in got[3] and "`role`" in got[3] and "Studio" not in got[3] and got[5] == got[7] and "Studio" in got[5] and got[8] == "no schema"


def jobs_of(spark, rows):
    return spark.createDataFrame(rows, "job string, code string, cost long, prio int")


def test_levels(spark):
    needs = [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "x"), ("e", "gone"), ("b", "a")]
    jobs = jobs_of(spark, [(j, "v", 1, 0) for j in "abcdexy"])
    got = P.levels(jobs, spark.createDataFrame(needs, "job string, needs string"))
    assert {r.job: r.level for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "x": 0, "y": 0}
    with pytest.raises(ValueError, match="cycle"):
        P.levels(jobs, spark.createDataFrame([*needs, ("a", "d")], "job string, needs string"))


def test_plan_of_jobs(spark):
    jobs = jobs_of(spark, [("a", "v1", 5, 1), ("b", "v1", 5, 2), ("c", "v1", 4, 0), ("d", "v1", 1, 0), ("e", "v1", 1, 0), ("f", "v2", 3, 1), ("g", "v1", 1, 0), ("h", "v1", 1, 0)])
    needs = spark.createDataFrame([("d", "b"), ("e", "a"), ("g", "d"), ("h", "gone")], "job string, needs string")
    finished = spark.createDataFrame([("c", "v1", "completed"), ("f", "v1", "completed"), ("a", "v1", "failed"), ("g", "v1", "completed")], "job string, code string, status string")
    got = P.plan_jobs(jobs, needs, finished, ["code"], [F.col("prio"), F.col("job")], "cost", 9)
    assert {r.job: (r.level, r.status, r.reason) for r in got.collect()} == {
        "c": (0, "reused", None), "a": (0, "admitted", "status failed"), "f": (0, "admitted", "code differs"), "b": (0, "over budget", "new"), "h": (0, "waiting", "new"),
        "d": (1, "waiting", "new"), "e": (1, "admitted", "new"), "g": (2, "reused", None),
    }


def test_resume_choice(spark):
    files = [("r", 10, "state"), ("r", 10, "weights"), ("r", 20, "weights"), ("r", 30, "state"), ("r", 5, "state"), ("r", 5, "weights"), ("r", 10, "state"), ("s", 7, "weights"), ("t", 3, "state"), ("t", 3, "weights"), ("t", 3, "more")]
    got = P.resume_choice(spark.createDataFrame(files, "run string, step long, file string"), ["state", "weights"], spark.createDataFrame([("r",), ("s",), ("t",), ("u",)], "run string"))
    assert {r.run: tuple(r)[1:] for r in got.collect()} == {"r": (10, 4, 2, 20, "resume"), "s": (None, 1, 1, None, "not resumable"), "t": (3, 1, 0, 0, "resume"), "u": (None, 0, 0, None, "start")}


def test_manifest_and_digest(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.bin").touch()  # is passed over
    for k in range(30):
        (tmp_path / "in" / f"d{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{k % 3}" / f"f{k}.bin").write_bytes(rng.randbytes([7, 1, 100, 101, 250][k % 5]))
    got = manifest(spark, str(tmp_path / "in"), chunk=100)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for f in (tmp_path / "in").rglob("f*.bin"):
        data = f.read_bytes()
        parts = [data[i : i + 100] for i in range(0, len(data), 100)] 
        want[str(f.relative_to(tmp_path / "in"))] = (len(data), len(parts), sha(data) if len(parts) == 1 else sha("".join(map(sha, parts)).encode()))
    assert {r.path: tuple(r)[1:] for r in got.collect()} == want
    level = [f"{want[p][2]} {p}" for p in sorted(want)]
    while True:
        level = [sha("\n".join(level[i : i + 4]).encode()) for i in range(0, len(level), 4)]
        if len(level) == 1:
            break
    assert tree_digest(got, width=4) == level[0] == tree_digest(got.repartition(7), width=4)
    assert tree_digest(got.limit(0)) == ""


def test_counters_of_examples(spark):
    rows = [("q", "S", None), ("q", "S", ""), ("q", "S", "a b"), ("q", "S", "a " * 100), ("q", "S " * 300, "a"), ("q " * 200, "S", "a")]
    counters = A.Counters()
    n = A.features(spark.createDataFrame(rows, "question string, schema_text string, target string"), 120, counters=counters).collect()
    got = counters.get()
    assert len(n) == got["kept"] == 3 and got["rows"] == 6 and got["empty_target"] == 2 and got["long_target"] == 1 and got["trimmed"] >= 2 and got["over_budget"] >= 1


def test_repeated_items_and_the_order_that_decides(spark):
    from tessera.operators.paired import paired_rows

    rows = [("a", 1, "y", 2), ("a", 1, "x", 1), ("a", 2, "p", 1), ("b", 1, "q", 5), ("b", 1, "r", 5), ("b", 2, "s", None), ("b", 2, "t", 1)]
    pairs = spark.createDataFrame([("a vs b", "a", "b")], "comparison string, job_a string, job_b string")
    for shuffled in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(shuffled, "job string, item int, v string, turn int").repartition(3)
        got = {r.item: (r.a_v, r.b_v) for r in paired_rows(df, pairs, "job", "item", ["v"], [F.col("turn").asc_nulls_last()]).collect()}
        assert got == {1: ("x", "q"), 2: ("p", "t")}


def test_middle_rows(spark):
    rows = [(g, k, n) for g, ns in {"a": [5, 1, 3, 3, 9, 2], None: [4], "z": [2, None, 2, 8]}.items() for k, n in enumerate(ns)]
    got = A.typical(spark.createDataFrame(rows, "g string, k int, n int").repartition(3), ["g"], "n", "k")
    assert sorted(((r.g, r.k, r.n) for r in got.collect()), key=str) == sorted([("a", 3, 3), (None, 0, 4), ("z", 2, 2)], key=str)
