from pyspark.sql import functions as F

from tessera.operators import schema as S

B = "Node properties are the following:\nMovie {title: STRING, released: INTEGER}, Person {name: STRING}\nThe relationships are the following:\n(:Person)-[:ACTED_IN]->(:Movie)"
A = "Node properties:\n- **Country**\n  - `name`: STRING Example: \"X\"\n  - `code`: STRING\n- **Country**\n  - `name`: TEXT\nRelationship properties:\n- **CONCERNS**\n  - `since`: DATE\nThe relationships:\n(:Filing)-[:CONCERNS]->(:Country)\n(:Filing)-[:CONCERNS]->(:Country)"


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, question string")


def test_parse(spark):
    got = [r.schema for r in S.parsed(frame(spark, (A, ""), (B, ""), ("nothing", ""), (None, "")), "text").orderBy("id").collect()]
    assert [(n.label, [(p.name, p.desc) for p in n.props]) for n in got[0].nodes] == [("Country", [("name", "TEXT"), ("code", "STRING")])]
    assert [r.label for r in got[0].rel_props] == ["CONCERNS"] and [tuple(p) for p in got[0].patterns] == [("Filing", "CONCERNS", "Country")]
    assert [n.label for n in got[1].nodes] == ["Movie", "Person"] and [tuple(p) for p in got[1].patterns] == [("Person", "ACTED_IN", "Movie")]
    assert [g.parsed for g in got] == [True, True, False, False] and got[3].raw == ""


def test_render_and_parse_again(spark):
    d = S.parsed(frame(spark, (A, ""), (B, "")), "text").withColumn("text", S.render(F.col("schema"))).select("id", "text", F.col("schema").alias("before"))
    for r in S.parsed(d, "text").collect():
        assert (r.before.nodes, r.before.rel_props, r.before.patterns) == (r.schema.nodes, r.schema.rel_props, r.schema.patterns)


def test_prune(spark):
    d = frame(spark, (B, "Who acted in Inception?"), (B, "zzz"), (B, "the of"), (B, "movie titles"), ("raw", "x"))
    got = [r.small for r in S.prune(S.parsed(d, "text"), "schema", "question", "small").orderBy("id").collect()]
    assert [n.label for n in got[0].nodes] == ["Person", "Movie"] and len(got[0].patterns) == 1  # ends of a hit pattern come back whole
    assert [n.label for n in got[1].nodes] == ["Movie", "Person"] and [n.label for n in got[2].nodes] == ["Movie", "Person"]  # nothing hit; no words
    assert [n.label for n in got[3].nodes] == ["Movie"] and not got[3].patterns
    assert not got[4].parsed


def test_similarity_keeps_a_partial_node(spark):
    scores = F.create_map(F.lit("node_prop|Movie|title"), F.lit(0.9), F.lit("node|Person|Person"), F.lit(0.5))
    d = S.prune_by_score(S.parsed(frame(spark, (B, "q")), "text").withColumn("m", scores), "schema", "m", "small")
    got = d.first().small
    assert [(n.label, [p.name for p in n.props]) for n in got.nodes] == [("Movie", ["title"]), ("Person", ["name"])] and len(got.patterns) == 1


def test_trim_never_takes_relationships(spark):
    d = frame(spark, (A, ""))
    for drop in (0, 1, 20, 10_000):
        text = S.trim(d, "text", F.lit(drop), "out").first().out
        assert text.count("(:Filing)") == 2 and (S.TRUNCATED in text) == (drop > 0)
    assert S.trim(d, "text", F.lit(0), "out").first().out == A


def test_budget(spark):
    got = S.fit_prompt(frame(spark, (A, "how many?"), ("", "")), "text", "question", F.lit(0), 190).orderBy("id").collect()
    assert got[0].schema_trimmed and got[0].schema_chars_untrimmed == len(A) and not got[1].schema_trimmed
    tight = S.fit_prompt(frame(spark, (A, "q")), "text", "question", F.lit(0), 10).first()
    assert tight.over_budget and tight.schema_trimmed


def test_modes(spark):
    d = frame(spark, (B, "Who acted?"))
    assert S.apply_mode(d, "text", "question", "none", "out").first().out == ""
    assert S.apply_mode(d, "text", "question", "enhanced", "out").first().out == B
    assert "`title`: STRING" in S.apply_mode(d, "text", "question", "base", "out").first().out
    try:
        S.apply_mode(d, "text", "question", "other", "out")
        raise AssertionError
    except ValueError:
        pass
