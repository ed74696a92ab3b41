"""The corpus pipeline's stages, each on what the one before it kept."""

import corpus_pipeline as P
from tests_support import rows_of


def test_stages(spark):
    d = rows_of(spark)
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        d = P.materialise(stage(spark, d, ""), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "extra"]
        kept[name] = sorted(r.doc_id for r in d.collect())
    assert kept["language_id"] == [1, 2, 3, 4, 5, 6] and kept["exact_dedup"] == [2, 3, 4, 5, 6] and kept["near_dedup"] == [2, 4, 5, 6]
    assert set(kept["mixing"]) <= {2, 4, 5, 6} and all(kept["mixing"].count(i) <= 2 for i in kept["mixing"])
    pieces = P.STAGES[-1][1](spark, d, "").collect()
    assert sorted(set(r.doc_id for r in pieces)) == sorted(set(kept["mixing"]))


def test_empty(spark):
    d = rows_of(spark).limit(0)
    for name, stage in P.STAGES:
        d = P.materialise(stage(spark, d, ""), name)
    assert d.count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    base = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"quite{k}" for k in range(60))
    rows = [(2, base), (3, base.replace("word59", "x")), (3, other), (7, other.replace("quite0", "y")), (9, "only here"), (9, "only here"), (None, base), (4, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS Kept", "2 AS kept2", "3 AS tag", "4 AS root")
    out = P.drop_near_copies(spark, d, "")
    assert out.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, base), (3, other), (9, "only here"), (None, base), (4, None), (4, "")], key=str)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, clashing names, ties and a very long text."""
    long = "el perro come en la casa y duerme " * 40_000
    rows = [(1, "the dog eats", "en", "a"), (1, "the dog eats", "en", "a"), (None, "the cat sleeps", None, None), (2, None, None, None), (3, "", "en", "b"), (4, long, "es", "a"), (5, long, "es", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'q' AS Lang_Pred", "1.5D AS SCORE", "1 AS keep_id", "true AS Kept", "2 AS h", "3 AS hit", "4 AS size", "5 AS __size", "6 AS copies", "7 AS c0")
    names = d.columns
    for name, stage in P.STAGES[:-1]:
        d = P.materialise(stage(spark, d, ""), name)
        assert d.columns == names
        rows = d.collect()
        assert rows and all((r["Lang_Pred"], r["SCORE"], r["Kept"], r["__size"], r["c0"]) == ("q", 1.5, True, 5, 7) for r in rows)
        if name == "exact_dedup":
            assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, None, 5], key=str)
    pieces = P.pack_sequences(spark, d, "").collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in pieces) and {r["doc_id"] for r in pieces} <= {1, None, 5}
