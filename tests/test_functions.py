import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.complexity import complexity
from tessera.functions.graph_query import query_elements
from tessera.functions.stats import holm, mcnemar, nearest_rank, wilson
from tessera.functions.text import alias_to_database, extract_answer, identifier_pieces, ner_mask, question_tokens, strip_leading
from tessera.functions.tokens import exact_match, gleu, gleu_counts, normalised_exact_match


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_gleu_counts_multisets(spark):
    d = spark.createDataFrame([(1, "a b c", "a b d"), (2, "a a", "a"), (3, "", "x"), (4, None, None)], "id int, g string, p string")
    c = gleu_counts(d, "g", "p", ["id"])
    got = {r[0]: tuple(r[1:]) for r in c.withColumn("s", gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold"))).collect()}
    assert got == {1: (3, 6, 6, 0.5), 2: (1, 3, 1, 1 / 3), 3: (0, 0, 1, 0.0), 4: (0, 0, 0, 0.0)}


def test_gleu_shuffles_once(spark):
    d = spark.createDataFrame([(1, "a", "b")], "id int, g string, p string")
    plan = gleu_counts(d, "g", "p", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("ab ;'", max_size=12), st.text("ab ;'", max_size=12)), min_size=1, max_size=8))
def test_gleu_is_symmetric_and_bounded(spark, pairs):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, g string, p string")
    score = gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold")).alias("s")
    one = {r.id: r.s for r in gleu_counts(d, "g", "p", ["id"]).select("id", score).collect()}
    two = {r.id: r.s for r in gleu_counts(d, "p", "g", ["id"]).select("id", score).collect()}
    assert one == two and all(0 <= v <= 1 for v in one.values())


def test_exact_match(spark):
    assert value(spark, exact_match(F.lit("RETURN 1;"), F.lit(" RETURN 1 ")))
    a, b = F.lit("match (n) return n"), F.lit("MATCH (n)\nRETURN n;")
    assert value(spark, normalised_exact_match(a, b)) and not value(spark, exact_match(a, b))


def test_complexity(spark):
    cases = {
        "MATCH (n:A) RETURN n": "easy", "MATCH (a)-[:R]->(b) RETURN b": "medium", "MATCH (a)-[:R*1..3]->(b) RETURN b": "extra_hard",
        "MATCH (a) WHERE a.x STARTS WITH 'q' RETURN a": "medium", "MATCH (a)<-[:R]-(b) RETURN count(a)": "hard", "": "easy",
    }
    for q, tier in cases.items():
        assert value(spark, complexity(F.lit(q)))["tier"] == tier, q
    assert not value(spark, complexity(F.lit("MATCH (a)-[r:R*1..3]->(b)")))["variable_length"]


def test_answers(spark):
    cases = {
        "```cypher\nMATCH (n) RETURN n;\n```": "MATCH (n) RETURN n", "<think>x</think>Cypher query: MATCH (n) RETURN n<|im_end|>junk": "MATCH (n) RETURN n",
        "Sure, here it is.\n\nMATCH (n) RETURN n\n\nHope it helps": "MATCH (n) RETURN n", "reasoning</think> RETURN 1": "RETURN 1", "": "", None: "",
    }
    for raw, want in cases.items():
        assert value(spark, extract_answer(F.lit(raw).cast("string"))) == want, raw


def test_questions(spark):
    q = "Which 3 countries have the most entities linked as beneficiaries in filings?"
    assert set(value(spark, question_tokens(F.lit(q)))) == {"countries", "country", "entities", "entity", "linked", "beneficiaries", "beneficiary", "filings", "filing"}
    assert set(value(spark, identifier_pieces(F.lit("ACTED_IN")))) == {"acted_in", "acted", "in"}
    assert set(value(spark, identifier_pieces(F.lit("dateOfBirth")))) == {"dateofbirth", "date", "of", "birth"}
    assert value(spark, ner_mask(F.lit("Which Barclays Bank filings exceed 1,000?"))) == "Which Barclays Bank filings exceed  NUMBER ?"
    assert value(spark, ner_mask(F.lit("List filings of Bob from Barclays"))) == "List filings of Bob from  ENTITY "


def test_names(spark):
    assert value(spark, alias_to_database(F.lit("neo4jlabs_demo_db_fincen"))) == "fincen"
    assert value(spark, alias_to_database(F.lit("demo_db__x_"))) == "x"
    assert value(spark, alias_to_database(F.lit(""))) is None
    assert value(spark, strip_leading(F.lit("<s>a<s>"), "<s>")) == "a<s>"


def test_query_elements(spark):
    e = value(spark, query_elements(F.lit("MATCH (a:Person {name: 'x:y'})-[:KNOWS|LIKES]->(b) WHERE a.age > 3 AND apoc.z RETURN b.born AS y, {c: a{.nick}}")))
    assert e["labels"] == ["Person"] and e["rel_types"] == ["KNOWS", "LIKES"] and e["properties"] == ["age", "born", "name", "nick"]


def test_statistics(spark):
    assert abs(value(spark, mcnemar(F.lit(1), F.lit(5))) - 0.21875) < 1e-12
    assert value(spark, mcnemar(F.lit(0), F.lit(0))) == 1.0
    for b, c in ((0, 9), (40, 60), (500, 430)):
        exact = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
        assert abs(value(spark, mcnemar(F.lit(b), F.lit(c))) - exact) < 1e-9 * max(exact, 1e-3)
    low, high = wilson(F.lit(0), F.lit(10))
    assert value(spark, low) == 0 and abs(value(spark, high) - 0.2775) < 1e-4
    assert value(spark, wilson(F.lit(0), F.lit(0))[0]) is None
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double").withColumn("g", F.lit(1))
    assert [round(r.p_holm, 9) for r in holm(d, "p", ["g"], ["i"]).orderBy("i").collect()] == [0.03, 0.06, 0.06]
    assert spark.range(1, 21).agg(nearest_rank(F.col("id"), 0.95)).first()[0] == 20
