"""Circuit breakers, lines out of pieces, and time limits of streams, over several micro-batches."""

import random

from pyspark.sql import functions as F

from tessera.streaming.guards import drain, file_stream
from tessera.streaming.state import breaker, carried, log_lines


def batches(spark, path: str, groups: list, schema: str):
    """A stream that brings each group of rows in a micro-batch of its own."""
    for k, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(0.05 * (k + 1 < len(groups)))  # files are taken in the order of their times
    return file_stream(spark, path, schema)


def test_a_circuit_opens_in_one_batch_and_stays_open_in_the_next(spark, tmp_path):
    groups = [[("a", 1, "lost"), ("a", 2, "lost"), ("b", 1, "lost"), ("b", 2, "ok")], [("a", 3, "lost"), ("a", 4, "ok"), ("b", 3, "lost"), ("b", 4, "lost")], [("a", 5, "ok"), ("b", 5, "bad"), ("b", 6, "lost")]]
    df = batches(spark, str(tmp_path / "in"), groups, "target string, n long, outcome string")
    call = lambda r: (r.outcome == "ok", r.outcome == "lost", r.outcome)
    got = drain(breaker(df, "target", "n", call), "out", str(tmp_path / "state"), rocksdb=True)
    assert sorted((r.target, r.n, r.called, r.ok, r.answer) for r in got.collect()) == [
        ("a", 1, True, False, "lost"), ("a", 2, True, False, "lost"), ("a", 3, True, False, "lost"), ("a", 4, False, False, "circuit open"), ("a", 5, False, False, "circuit open"),
        ("b", 1, True, False, "lost"), ("b", 2, True, True, "ok"), ("b", 3, True, False, "lost"), ("b", 4, True, False, "lost"), ("b", 5, True, False, "bad"), ("b", 6, True, False, "lost"),
    ]


def test_a_timer_closes_the_circuit(spark, tmp_path):
    groups = [[("a", n, "lost") for n in range(4)], [("b", 1, "ok")], [("a", 9, "ok")]]
    df = batches(spark, str(tmp_path / "in"), groups, "target string, n long, outcome string")
    # a stream with timers goes on when its input has ended; the clock here counts micro-batches
    clock = lambda: len(list(tmp_path.glob("state-out/batch=*")))
    got = drain(breaker(df, "target", "n", lambda r: (r.outcome == "ok", r.outcome == "lost", None), retry_after_ms=0), "out", str(tmp_path / "state"), seconds=4, clock=clock, rocksdb=True)
    assert {(r.target, r.n): r.called for r in got.collect()} == {("a", 0): True, ("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("a", 9): True}


LOG = "start\r\n\n 1%\r 50%\r100% done\nno end\rnor here\r\nlast \r7\r\n\nrest\rof it"


def test_any_cut_gives_the_same_lines(spark, tmp_path):
    want, rest = carried("", LOG)
    want = [*want, rest.rsplit("\r", 1)[-1]]
    assert want == ["start", "", "100% done", "nor here", "7", "", "of it"]
    rng, groups = random.Random(6), [[], [], []]
    for f in range(12):
        cuts = sorted({0, len(LOG), *(rng.randrange(len(LOG)) for _ in range(rng.choice([0, 3, 20, 60])))})
        pieces = [(f"f{f}", a, LOG[a:b], b == len(LOG)) for a, b in zip(cuts, cuts[1:])]
        for p in [*pieces, *rng.sample(pieces, len(pieces) // 3)]:  # some come twice
            groups[rng.randrange(3)].append(p)
    groups[1].append(("open", 0, "a\nb\rc", False))
    groups[2].append(("late", 5, "x\n", True))
    df = batches(spark, str(tmp_path / "in"), groups, "file string, offset long, text string, last boolean")
    got = {}
    for r in drain(log_lines(df), "out", str(tmp_path / "state"), rocksdb=True).collect():
        assert got.setdefault((r.file, r.line_number), r.line) == r.line
    assert got == {(f"f{f}", k): line for f in range(12) for k, line in enumerate(want)} | {("open", 0): "a"}


def test_a_stopped_stream_goes_on_without_loss_or_repeat(spark, tmp_path):
    df = lambda: file_stream(spark, str(tmp_path / "in"), "id long")
    spark.range(0, 60, 1, 6).write.parquet(str(tmp_path / "in"))
    ticks = iter(range(1000))
    run = lambda s: drain(df(), "out", str(tmp_path / "state"), seconds=s, clock=lambda: next(ticks))
    n = [run(0).count(), run(1).count()]
    assert n[0] == 10 and 10 < n[1] < 60
    assert sorted(r.id for r in drain(df(), "out", str(tmp_path / "state"), seconds=10_000).collect()) == list(range(60))
    # nothing is left: a further run adds nothing
    out = drain(df(), "out", str(tmp_path / "state"))
    assert out.count() == 60 and out.agg(F.countDistinct("id")).first()[0] == 60


def test_a_stopped_count_goes_on_with_its_state(spark, tmp_path):
    spark.range(0, 60, 1, 6).write.parquet(str(tmp_path / "in"))
    counted = lambda: file_stream(spark, str(tmp_path / "in"), "id long").groupBy((F.col("id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    first = drain(counted(), "out", str(tmp_path / "state"), "complete", seconds=0)
    assert sum(r.n for r in first.collect()) == 10
    assert sorted((r.k, r.n) for r in drain(counted(), "out", str(tmp_path / "state"), "complete").collect()) == [(0, 20), (1, 20), (2, 20)]
