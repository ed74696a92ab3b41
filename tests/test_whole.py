"""Whole jobs against brute force, where a query once did a part."""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd

from tessera.functions.tokens import gleu_counts
from tessera.operators.paired import bootstrap_difference
from tessera.plans import all_plans, bindings, statistics

SF = "/root/testdata/sf0.001"


def test_cosines_are_of_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    e = pd.DataFrame({"vec_id": range(90), "label": [i % 3 for i in range(90)], "embedding": [list(map(float, rng.normal(size=7) + np.array([0, 0, 0, 0, 1, 1, 1]) * (i % 3))) for i in range(90)]})
    e.to_parquet(tmp_path / "embeddings.parquet")
    for folder in (str(tmp_path), SF):
        got = {r["label"]: (r["n"], r["mean_score"]) for r in all_plans()["cosine_filter"][0](spark, folder).collect()}
        want = {}
        for label, g in pd.read_parquet(f"{folder}/embeddings.parquet").groupby("label"):
            v = np.array([np.asarray(x, np.float64) for x in g["embedding"]])
            c = v.mean(0)
            s = v @ c / (np.linalg.norm(v, axis=1) * np.linalg.norm(c))
            if (s >= 0.45).any():
                want[label] = (int((s >= 0.45).sum()), round(float(s[s >= 0.45].mean()), 4))
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
        assert all(abs(got[k][1] - m) < 2e-4 for k, (_, m) in want.items())


def draws(n):
    """The rows of each of 2,000 resamples of n rows."""
    return np.array([[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(1, 2001)])


def test_intervals_are_of_2000_resamples(spark):
    c = gleu_counts(bindings.pairs(spark, SF), "gold_cypher", "predicted_cypher", ["id"]).collect()
    groups = defaultdict(list)
    for r in sorted(c, key=lambda r: r["id"]):
        groups[r["id"] // 1000 % 4].append((r["overlap"], r["n_gold"], r["n_pred"]))
    got = {r["grp"]: (r["ci_low"], r["ci_high"]) for r in all_plans()["bootstrap_gleu_ci"][0](spark, SF).collect()}
    assert got.keys() == groups.keys()
    for g, rows in groups.items():
        o, a, b = np.array(rows, float)[draws(len(rows))].sum(1).T
        with np.errstate(invalid="ignore", divide="ignore"):
            m = np.where((a > 0) & (b > 0), np.minimum(o / a, o / b), 0.0)
        assert np.allclose(got[g], np.quantile(m, [0.025, 0.975]), atol=2e-6)


def test_p_values_are_of_2000_resamples(spark):
    groups = defaultdict(list)
    for r in statistics._compared(spark, SF).select("comparison", "item", "a_gleu", "b_gleu").collect():
        groups[r["comparison"]].append((r["item"], round(r["b_gleu"] - r["a_gleu"], 6)))
    got = {r["comparison"]: r for r in all_plans()["paired_bootstrap_tost"][0](spark, SF).collect()}
    assert got.keys() == groups.keys()
    for g, rows in groups.items():
        m = np.array([d for _, d in sorted(rows)])[draws(len(rows))].mean(1)
        r = got[g]
        assert np.allclose([r["ci_low"], r["ci_high"], r["tost_low"], r["tost_high"]], np.quantile(m, [0.025, 0.975, 0.05, 0.95]), atol=2e-6)
        p = min(1, 2 * min((m <= 1e-12).mean(), (m >= -1e-12).mean()))
        assert abs(r["p_value"] - max(p, 1 / 2000)) < 2e-3 and r["p_is_bound"] == (p < 1 / 2000)
    sure = spark.createDataFrame([(i, 0.0, 1.0 + i) for i in range(5)], "item int, a double, b double").selectExpr("'x' AS g", "*")
    r = bootstrap_difference(sure, ["g"], "item", "a", "b").first()
    assert r["p_value"] == 1 / 2000 and r["p_is_bound"]
