"""Queries of the schema, question, answer and coverage family."""

from pyspark.sql import functions as F

from tessera.functions.graph_query import query_elements
from tessera.functions.text import SYSTEM, USER, alias_to_database, extract_answer, identifier_pieces, is_connectivity_error, is_ordered, ner_mask, plain_prompt, question_tokens
from tessera.functions.tokens import tokens
from tessera.operators import schema as S
from tessera.plans.bindings import _T
from tessera.plans.scoring import rounded
from tessera.session import read, spread

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


#: Schema texts made of a part: one in each notation, and one that cannot be parsed. Valid in both engines.
_NL = "chr(10)"
_SCHEMA = f"""CASE p_partkey % 3 WHEN 0 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING Example: "', p_name, '"', {_NL}, '  - `retailPrice`: FLOAT Min: 1, Max: 9', {_NL},
'- **Supplier**', {_NL}, '  - `name`: STRING', {_NL}, 'Relationship properties:', {_NL}, '- **SUPPLIED_BY**', {_NL}, '  - `since`: DATE', {_NL}, 'The relationships:', {_NL}, '(:Part', p_size, ')-[:SUPPLIED_BY]->(:Supplier)')
WHEN 1 THEN concat('Node properties are the following:', {_NL}, 'Part', p_size, ' {{name: STRING, size: INTEGER}}, Brand {{title: STRING}}', {_NL}, 'The relationships are the following:', {_NL}, '(:Part', p_size, ')-[:HAS_BRAND]->(:Brand)')
ELSE p_name END"""
_QUESTION = "concat('Which suppliers of ', p_type, ' have the part', p_size, ' of brand ', p_brand, '?')"
_KIND = "p_partkey % 3"


def _parts(spark, sf_dir):
    return spread(read(spark, sf_dir, "part")).select("p_partkey", "p_size", F.expr(_SCHEMA).alias("schema_text"), F.expr(_QUESTION).alias("question"))


@plan(f"""SELECT p_partkey, p_partkey % 3 <> 2 AS parsed, (CASE {_KIND} WHEN 2 THEN 0 ELSE 2 END)::INTEGER AS nodes, (CASE {_KIND} WHEN 2 THEN 0 ELSE 3 END)::INTEGER AS node_properties,
(CASE {_KIND} WHEN 0 THEN 1 ELSE 0 END)::INTEGER AS relationship_types, (CASE {_KIND} WHEN 2 THEN 0 ELSE 1 END)::INTEGER AS patterns FROM part""")
def schema_parse_elements(spark, sf_dir):
    p = S.parsed(_parts(spark, sf_dir), "schema_text")
    return p.select("p_partkey", F.col("schema.parsed").alias("parsed"), S.size(F.col("schema")).alias("s")).select("p_partkey", "parsed", "s.*")


@plan(f"""SELECT p_partkey, CASE {_KIND} WHEN 0 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING', {_NL}, '  - `retailPrice`: FLOAT', {_NL}, '- **Supplier**', {_NL}, '  - `name`: STRING', {_NL},
'Relationship properties:', {_NL}, '- **SUPPLIED_BY**', {_NL}, '  - `since`: DATE', {_NL}, 'The relationships:', {_NL}, '(:Part', p_size, ')-[:SUPPLIED_BY]->(:Supplier)')
WHEN 1 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING', {_NL}, '  - `size`: INTEGER', {_NL}, '- **Brand**', {_NL}, '  - `title`: STRING', {_NL}, 'Relationship properties:', {_NL}, 'The relationships:', {_NL}, '(:Part', p_size, ')-[:HAS_BRAND]->(:Brand)')
ELSE p_name END AS base FROM part""")
def schema_render(spark, sf_dir):
    return S.apply_mode(_parts(spark, sf_dir), "schema_text", "question", "base", "base").select("p_partkey", "base")


@plan(f"""WITH t AS (SELECT p_partkey, p_size, p_name, {_SCHEMA} AS s FROM part)
SELECT p_partkey, CASE {_KIND} WHEN 0 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING Example: "', p_name, '"', {_NL}, '  - `retailPrice`: FLOAT Min: 1, Max: 9', {_NL}, '- **Supplier**', {_NL}, '  - `name`: STRING', {_NL},
'Relationship properties:', {_NL}, 'The relationships:', {_NL}, '(:Part', p_size, ')-[:SUPPLIED_BY]->(:Supplier)')
WHEN 1 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING', {_NL}, '  - `size`: INTEGER', {_NL}, '- **Brand**', {_NL}, '  - `title`: STRING', {_NL}, 'Relationship properties:', {_NL}, 'The relationships:', {_NL}, '(:Part', p_size, ')-[:HAS_BRAND]->(:Brand)')
ELSE s END AS exact_match FROM t""")
def schema_prune_exact(spark, sf_dir):
    return S.apply_mode(_parts(spark, sf_dir), "schema_text", "question", "exact_match", "exact_match").select("p_partkey", "exact_match")


@plan(f"""SELECT p_partkey, CASE {_KIND} WHEN 0 THEN concat('Node properties:', {_NL}, '- **Part', p_size, '**', {_NL}, '  - `name`: STRING Example: "', p_name, '"', {_NL}, '- **Supplier**', {_NL}, 'Relationship properties:', {_NL}, '- **SUPPLIED_BY**', {_NL},
'The relationships:', {_NL}, '(:Part', p_size, ')-[:SUPPLIED_BY]->(:Supplier)', {_NL}, '  ... (properties truncated)') ELSE {_SCHEMA} END AS trimmed FROM part""")
def schema_trim(spark, sf_dir):
    return S.trim(_parts(spark, sf_dir), "schema_text", F.lit(60), "trimmed").select("p_partkey", "trimmed")


@plan()
def schema_prune_modes(spark, sf_dir):
    """Characters of each mode's text."""
    d = _parts(spark, sf_dir)
    for mode in S.MODES[:5]:
        d = S.apply_mode(d, "schema_text", "question", mode, f"m_{mode}")
    return d.select("p_partkey", *[F.length(f"m_{m}").alias(f"chars_{m}") for m in S.MODES[:5]])


@plan()
def schema_prune_similarity(spark, sf_dir):
    """Pruned by scores that stand for an encoder's."""
    d = _parts(spark, sf_dir).withColumn("scores", F.create_map(F.lit("node|Supplier|Supplier"), F.lit(0.9), F.lit("node_prop|Brand|title"), F.lit(0.5)))
    return S.apply_mode(d, "schema_text", "question", "similarity", "pruned", scores="scores").select("p_partkey", "pruned")


@plan()
def prompt_budget(spark, sf_dir):
    """Prompts that are trimmed to a budget of tokens."""
    f = S.fit_prompt(_parts(spark, sf_dir), "schema_text", "question", F.lit(8), 175)
    return f.select("p_partkey", "prompt_tokens", "schema_chars_untrimmed", F.length("schema_text").alias("schema_chars"), "schema_trimmed", "over_budget")


@plan(f"SELECT p_partkey, len(regexp_extract_all(concat('x ', {_QUESTION}), {_T}))::INTEGER AS n_tokens FROM part")
def question_lengths(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.size(tokens(F.concat(F.lit("x "), "question"))).alias("n_tokens"))



@plan(r"""WITH p AS (SELECT page_id, replace(replace(url, ':', '-'), '/', '-') AS u FROM pages), c AS (SELECT page_id, u, regexp_split_to_array(u, '[_\-\s.]+') AS k FROM p),
s AS (SELECT page_id, list_concat([lower(u)], list_concat(list_transform(k, lambda x: lower(x)), list_transform(flatten(list_transform(k, lambda x: string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: lower(x)))) AS a FROM c)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: length(x) > 1))), ' ') AS pieces FROM s""")
def identifier_split(spark, sf_dir):
    u = F.replace(F.replace(F.col("url"), F.lit(":"), F.lit("-")), F.lit("/"), F.lit("-"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(identifier_pieces(u)), " ").alias("pieces"))


@plan()
def question_words(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.size(question_tokens(F.col("text"))).alias("n_words"))


@plan()
def masked_questions(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).select("doc_id", ner_mask(F.col("text")).alias("masked"))


_RAW = f"""CASE conv_id % 4 WHEN 0 THEN concat('Sure.', {_NL}, {_NL}, 'MATCH (n) RETURN n.x', turn, ';', {_NL}, {_NL}, 'Bye') WHEN 1 THEN concat('```cypher', {_NL}, 'RETURN ', turn, ';', {_NL}, '```')
WHEN 2 THEN concat('<think>no</think>Cypher query: MATCH (a) RETURN a', turn, '<|im_end|>junk') ELSE concat('reasoning</think> RETURN ', turn) END"""


@plan("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN concat('MATCH (n) RETURN n.x', turn) WHEN 1 THEN concat('RETURN ', turn) WHEN 2 THEN concat('MATCH (a) RETURN a', turn) ELSE concat('RETURN ', turn) END AS answer FROM conversations""")
def extract_answers(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", extract_answer(F.expr(_RAW)).alias("answer"))


_ALIAS = "CASE c_custkey % 4 WHEN 0 THEN concat('neo4jlabs_demo_db_', c_name) WHEN 1 THEN concat(' demo_db__', c_name, '_ ') WHEN 2 THEN 'neo4j_demo_' ELSE c_name END"


@plan("SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN NULL ELSE c_name END AS db, c_custkey % 5 = 0 AS broken, c_custkey % 7 = 0 AS ordered FROM customer")
def database_aliases(spark, sf_dir):
    e = F.when(F.col("c_custkey") % 5 == 0, "ServiceUnavailable: Connection Refused").otherwise("SyntaxError: x")
    q = F.when(F.col("c_custkey") % 7 == 0, "RETURN a ORDER  BY b").otherwise("RETURN reorder by")
    return read(spark, sf_dir, "customer").select("c_custkey", alias_to_database(F.expr(_ALIAS)).alias("db"), is_connectivity_error(e).alias("broken"), is_ordered(q).alias("ordered"))


_GOLD = "concat('MATCH (a:Part', p_size, ')-[:SUPPLIED_BY|HAS_BRAND]->(b:Supplier {name: ''x''}) WHERE a.retailPrice > 1 AND z.q = 2 RETURN b.name AS y')"


@plan("SELECT p_partkey, concat('Part', p_size, ',Supplier') AS labels, 'HAS_BRAND,SUPPLIED_BY' AS rel_types, 'name,retailPrice' AS properties FROM part")
def query_parts(spark, sf_dir):
    e = read(spark, sf_dir, "part").select("p_partkey", query_elements(F.expr(_GOLD)).alias("e"))
    return e.select("p_partkey", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("labels", "rel_types", "properties")])


def _coverage(spark, sf_dir):
    """Elements of a query that its schema has, and those that the pruned schema has lost."""
    d = _parts(spark, sf_dir).withColumn("e", query_elements(F.expr(_GOLD)))
    d = S.prune(S.parsed(d, "schema_text"), "schema", "question", "small").filter("schema.parsed")
    d = S.unknown_elements(d, "e", "schema", "small")
    return d.withColumn("kind", (F.col("p_partkey") % 3).cast("string"))


@plan("""WITH k AS (SELECT (p_partkey % 3)::VARCHAR AS kind FROM part WHERE p_partkey % 3 <> 2)
SELECT coalesce(kind, 'all') AS grp, count(*) AS n_parsed, 1.0::DOUBLE AS share_fully_covered, round(avg((kind = '1')::INTEGER), 4) AS share_unknown_label, round(avg(1), 4)::DOUBLE AS share_unknown_rel_type FROM k GROUP BY GROUPING SETS ((), (kind))""")
def coverage_sets(spark, sf_dir):
    c = _coverage(spark, sf_dir)
    lost = F.col("missing_labels") + F.col("missing_rel_types") + F.col("missing_properties")
    g = c.groupingSets([[], [F.col("kind")]], F.col("kind")).agg(F.count(F.lit(1)).alias("n_parsed"), F.avg((lost == 0).cast("double")).alias("share_fully_covered"), F.avg((F.col("unknown_labels") > 0).cast("double")).alias("share_unknown_label"), F.avg((F.col("unknown_rel_types") > 0).cast("double")).alias("share_unknown_rel_type"))
    return rounded(g.select(F.coalesce("kind", F.lit("all")).alias("grp"), "n_parsed", "share_fully_covered", "share_unknown_label", "share_unknown_rel_type"))


@plan("""SELECT p_size % 5 AS job, count(*) AS n_checked, round(avg((p_partkey % 3 = 1)::INTEGER), 4) AS share_unknown_label, round(avg((p_partkey % 3 = 1)::INTEGER), 4) AS share_unknown_property FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1""")
def hallucination_share(spark, sf_dir):
    c = _coverage(spark, sf_dir)
    flag = lambda k: F.avg((F.col(f"unknown_{k}") > 0).cast("double"))
    return rounded(c.groupBy((F.col("p_size") % 5).alias("job")).agg(F.count(F.lit(1)).alias("n_checked"), flag("labels").alias("share_unknown_label"), flag("properties").alias("share_unknown_property")))


@plan("""WITH d AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents), b AS (SELECT list_distinct(flatten(list(string_split(text, ' ')))) AS w FROM benchmark)
SELECT doc_id, len(list_intersect(d.w, b.w))::INTEGER AS shared, len(d.w)::INTEGER AS own FROM d, b""")
def element_overlap(spark, sf_dir):
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    hits = d.select("doc_id", F.explode("w").alias("w")).join(words, "w").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    return d.select("doc_id", F.size("w").alias("own")).join(hits, "doc_id", "left").select("doc_id", F.coalesce("shared", F.lit(0)).cast("int").alias("shared"), "own")


@plan(f"SELECT p_partkey, md5({_QUESTION}) AS question_key, substr(sha256(concat_ws('|', p_brand, p_type)), 1, 16) AS cache_key FROM part")
def cache_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.md5(F.expr(_QUESTION).cast("binary")).alias("question_key"), F.left(F.sha2(F.concat_ws("|", "p_brand", "p_type").cast("binary"), 256), F.lit(16)).alias("cache_key"))


_PROMPT = [f"'{part}'" for part in f"{SYSTEM}\n\n{USER}".split("%s")]


@plan(f"SELECT p_partkey, concat({_PROMPT[0]}, {_SCHEMA}, {_PROMPT[1]}, {_QUESTION}, {_PROMPT[2]}) AS prompt FROM part")
def plain_prompts(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", plain_prompt(F.col("schema_text"), F.col("question")).alias("prompt"))
