import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import breakdowns, ordering

SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def rows_of(spark):
    rng = np.random.default_rng(5)
    a = [(k % 3 if k % 50 else None, float(rng.lognormal()) if k % 7 else None, float(k % 4), None) for k in range(4000)] + [(9, 1.5, None, None), (8, None, None, None), (7, -0.0, 1.0, None), (7, 2.0, 3.0, None)]
    return a, spark.createDataFrame(a, "g long, x double, y double, z double").repartition(7)


@pytest.mark.parametrize("slack", [ordering.SLACK, -0.1])  # brackets of less than nothing miss their places, which are then found without
def test_percentiles_against_numpy(spark, monkeypatch, slack):
    monkeypatch.setattr(ordering, "SLACK", slack)
    a, d = rows_of(spark)
    got = {r.g: r for r in ordering.percentiles(d, ["g"], {c: F.col(c) for c in "xyz"}, SHARES).collect()}
    for g in {r[0] for r in a}:
        for i, c in enumerate("xyz"):
            v = [r[1 + i] for r in a if r[0] == g and r[1 + i] is not None]
            for s, p in SHARES.items():
                have = got[g][f"{c}_{s}"] if g in got else None
                assert have is None if not v else have == pytest.approx(np.quantile(v, p), rel=1e-12), (g, c, s)


def test_latency_holds_no_groups_values(spark):
    """No exact percentile or median aggregate, whose state is a map of all of a group's values, in any plan that is run."""
    _, d = rows_of(spark)
    seen, real = [], ordering.staged
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    ordering.staged = lambda df, label="t": (seen.append(plan(df)), real(df, label))[1]
    try:
        got = breakdowns.latency_stats(d.withColumn("s", F.lit(True)).withColumn("e", F.lit("x")), ["g"], "x", "y", "z", "y", "y", "x", "y", "s", "e")
    finally:
        ordering.staged = real
    assert got.count() == 7 and len(seen) > 1
    assert not any(f" {f}(" in f" {p}" for p in [*seen, plan(got)] for f in ("percentile", "median"))
