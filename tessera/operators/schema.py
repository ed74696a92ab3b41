"""Graph schemas: parse, render, prune and trim their text, row by row and without a shuffle.

A parsed schema is a struct of nodes and rel_props (arrays of label and props, props of name and desc, in the order of the text), patterns
(src, rel, dst), raw and parsed.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import identifier_pieces, ner_mask, plain_prompt, question_tokens
from tessera.functions.tokens import strip, tokens

#: The two notations of a schema's text, and the mark of a trimmed one.
NODE_SECTION, REL_SECTION, PATTERN_SECTION = r"(?i)\A\s*node properties", r"(?i)\A\s*relationship properties", r"(?i)\A\s*the relationships"
LABEL_LINE, PROPERTY_LINE = r"\A\s*-\s*\*\*([^*]+)\*\*\s*\z", r"\A\s*-\s*`([^`]+)`\s*:\s*(.*)\z"
PATTERN = r"\(:?([A-Za-z_][\w]*)?\)\s*-\s*\[:([A-Za-z_][\w]*)\]\s*->\s*\(:?([A-Za-z_][\w]*)?\)"
INLINE = r"([A-Za-z_][\w]*)\s*\{([^}]*)\}"
EXAMPLE = r"(?i)\s*(Example:.*|Min:.*?Max:.*?)$"
TRUNCATED = "  ... (properties truncated)"
MODES = ("none", "enhanced", "base", "exact_match", "ner_exact_match", "similarity")
_EVENT = "array<struct<kind:string,owner:string,name:string,desc:string,head:boolean>>"
_STATE = "struct<sec:string,lab:string,out:array<struct<sec:string,lab:string>>>"
#: Line ends besides \n.
_BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one after a break at its end."""
    return F.split(F.regexp_replace(text, rf"(?:{_BREAKS})\z", ""), _BREAKS)


def _event(kind, owner, name, desc, head) -> Column:
    return F.struct(kind.alias("kind"), owner.alias("owner"), name.alias("name"), desc.alias("desc"), head.alias("head"))


_NONE = lambda: F.lit(None).cast("string")


def _patterns(line: Column, head: Column) -> Column:
    every = lambda g: F.regexp_extract_all(line, F.lit(PATTERN), F.lit(g))
    zipped = F.arrays_zip(every(1).alias("s"), every(2).alias("r"), every(3).alias("d"))
    return F.transform(zipped, lambda x: _event(F.lit("pattern"), x["s"], x["r"], x["d"], head)).cast(_EVENT)


def _inline(line: Column, kind: Column, head: Column) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(line, F.lit(INLINE), F.lit(1)).alias("l"), F.regexp_extract_all(line, F.lit(INLINE), F.lit(2)).alias("b"))

    def one(x):
        parts = F.filter(F.split(x["b"], ","), lambda p: p.contains(":"))
        props = F.transform(parts, lambda p: _event(kind, x["l"], strip(F.substring_index(p, ":", 1)), strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))), head))
        return F.concat(F.array(_event(kind, x["l"], _NONE(), _NONE(), head)).cast(_EVENT), props.cast(_EVENT))

    return F.flatten(F.transform(found, one))


def parsed(df: DataFrame, text: str, out: str = "schema") -> DataFrame:
    """Adds the schema in a text. A text in which nothing is found is kept raw with parsed = false.

    Lines, their sections and their events are columns of their own, so that each is worked out once a row.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__lines", F.filter(F.transform(lines(raw), lambda l: F.struct(l.alias("line"), strip(l).alias("bare"))), lambda x: x["bare"] != ""))
    rows = F.col("__lines")
    section = lambda b: F.when(b.rlike(NODE_SECTION), "node").when(b.rlike(REL_SECTION), "rel").when(b.rlike(PATTERN_SECTION), "patterns")

    def step(acc, x):
        head, in_body = section(x["bare"]), acc["sec"].isin("node", "rel")
        label = in_body & ~x["bare"].rlike(PATTERN) & x["line"].rlike(LABEL_LINE)
        sec = F.coalesce(head, acc["sec"])
        lab = F.when(head.isNotNull(), _NONE()).when(label, strip(F.regexp_extract(x["line"], LABEL_LINE, 1))).otherwise(acc["lab"])
        return F.struct(sec.alias("sec"), lab.alias("lab"), F.concat(acc["out"], F.array(F.struct(sec.alias("sec"), lab.alias("lab")))).alias("out")).cast(_STATE)

    start = F.struct(_NONE().alias("sec"), _NONE().alias("lab"), F.array().cast("array<struct<sec:string,lab:string>>").alias("out")).cast(_STATE)
    df = df.withColumn("__states", F.aggregate(rows, start, step)["out"])

    def events(x, s):
        b, line, yes, no = x["bare"], x["line"], F.lit(True), F.lit(False)
        head, body = section(b), s["sec"].isin("node", "rel")
        prop = F.array(_event(s["sec"], s["lab"], strip(F.regexp_extract(line, PROPERTY_LINE, 1)), strip(F.regexp_extract(line, PROPERTY_LINE, 2)), no)).cast(_EVENT)
        # a line with a brace counts as structure even if no entity is found in it
        brace = F.array(_event(F.lit("brace"), _NONE(), _NONE(), _NONE(), no)).cast(_EVENT)
        return (
            F.when(head.isin("node", "rel"), _inline(b, head, yes)).when(head == "patterns", _patterns(b, yes))
            .when(b.rlike(PATTERN), _patterns(b, no))
            .when(body & line.rlike(LABEL_LINE), F.array(_event(s["sec"], s["lab"], _NONE(), _NONE(), no)).cast(_EVENT))
            .when(body & s["lab"].isNotNull() & line.rlike(PROPERTY_LINE), prop)
            .when(body & b.contains("{"), F.concat(brace, _inline(b, s["sec"], no)))
            .otherwise(F.array().cast(_EVENT)))

    df = df.withColumn("__events", F.flatten(F.zip_with(rows, F.col("__states"), events)))
    every = F.col("__events")

    def owners(kind):
        mine = F.filter(every, lambda e: e["kind"] == kind)
        labels = F.array_distinct(F.transform(mine, lambda e: e["owner"]))

        def one(label):
            own = F.filter(mine, lambda e: (e["owner"] == label) & e["name"].isNotNull())
            names = F.array_distinct(F.transform(own, lambda e: e["name"]))
            return F.struct(label.alias("label"), F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter(own, lambda e: e["name"] == n), -1)["desc"].alias("desc"))).alias("props"))

        return F.transform(labels, one)

    df = df.withColumn("__found", F.filter(every, lambda e: e["kind"] == "pattern"))
    found = F.col("__found")
    df = df.withColumn("__keys", F.transform(found, lambda e: F.concat_ws("\x01", e["owner"], e["name"], e["desc"])))
    keys = F.col("__keys")
    first = F.filter(found, lambda e, i: e["head"] | (F.array_position(keys, F.get(keys, i)) == i + 1))
    patterns = F.transform(first, lambda e: F.struct(e["owner"].alias("src"), e["name"].alias("rel"), e["desc"].alias("dst")))
    any_ = F.exists(every, lambda e: ~e["head"] | (e["kind"] == "pattern"))
    df = df.withColumn(out, F.struct(owners("node").alias("nodes"), owners("rel").alias("rel_props"), patterns.alias("patterns"), raw.alias("raw"), any_.alias("parsed")))
    return df.drop("__lines", "__states", "__events", "__found", "__keys")


def render(s: Column, examples: bool = True) -> Column:
    """A schema as text again; without examples, descriptions lose their example or range."""

    def block(owners):
        def one(x):
            desc = lambda p: p["desc"] if examples else strip(F.regexp_replace(p["desc"], EXAMPLE, ""))
            row = lambda p: F.regexp_replace(F.concat(F.lit("  - `"), p["name"], F.lit("`: "), desc(p)), r"\s+\z", "")
            return F.concat(F.array(F.concat(F.lit("- **"), x["label"], F.lit("**"))), F.transform(x["props"], row))

        return F.flatten(F.transform(owners, one))

    links = F.transform(s["patterns"], lambda p: F.concat(F.lit("(:"), p["src"], F.lit(")-[:"), p["rel"], F.lit("]->(:"), p["dst"], F.lit(")")))
    rows = F.concat(F.array(F.lit("Node properties:")), block(s["nodes"]), F.array(F.lit("Relationship properties:")), block(s["rel_props"]), F.array(F.lit("The relationships:")), links)
    return F.when(s["parsed"], F.array_join(rows, "\n")).otherwise(s["raw"])


def size(s: Column) -> Column:
    count = F.aggregate(s["nodes"], F.lit(0), lambda n, x: n + F.size(x["props"]))
    return F.struct(F.size(s["nodes"]).alias("nodes"), count.alias("node_properties"), F.size(s["rel_props"]).alias("relationship_types"), F.size(s["patterns"]).alias("patterns"))


def _kept(owners: Column, whole: Callable, part: Callable) -> Column:
    """Owners that are hit whole, or with only the properties that are hit."""
    each = F.transform(owners, lambda x: F.struct(x["label"].alias("label"), F.when(whole(x), x["props"]).otherwise(F.filter(x["props"], lambda p: part(x, p))).alias("props"), whole(x).alias("w")))
    kept = F.filter(each, lambda x: x["w"] | (F.size(x["props"]) > 0))
    return F.transform(kept, lambda x: F.struct(x["label"], x["props"]))


def _connected(s: Column, nodes: Column, patterns: Column) -> Column:
    """Kept nodes, and whole those at the ends of kept patterns that are missing, in the order of the patterns."""
    ends = F.array_distinct(F.flatten(F.transform(patterns, lambda p: F.array(p["src"], p["dst"]))))
    have = F.transform(nodes, lambda x: x["label"])
    more = F.filter(ends, lambda e: ~F.array_contains(have, e))
    return F.concat(nodes, F.flatten(F.transform(more, lambda e: F.filter(s["nodes"], lambda x: x["label"] == e))))


def prune(df: DataFrame, schema: str, question: str, out: str, min_nodes: int = 1, patterns_of_kept_nodes: bool = True) -> DataFrame:
    """Adds the part of a schema that a question's words name: nodes and relationship types whole on their own name, else with the
    properties that are named; patterns on their type or if both ends are kept; ends of kept patterns. The whole schema if the question
    has no words or nothing is left, and an unparsed one as it is."""
    s, q = F.col(schema), F.col("__tokens")
    hit = lambda name: F.arrays_overlap(identifier_pieces(name), q)
    df = df.withColumn("__tokens", question_tokens(F.col(question)))
    df = df.withColumn("__nodes", _kept(s["nodes"], lambda x: hit(x["label"]), lambda x, p: hit(p["name"])))
    df = df.withColumn("__rels", _kept(s["rel_props"], lambda x: hit(x["label"]), lambda x, p: hit(p["name"])))
    have = F.transform(F.col("__nodes"), lambda x: x["label"])
    both = lambda p: F.array_contains(have, p["src"]) & F.array_contains(have, p["dst"]) if patterns_of_kept_nodes else F.lit(False)
    df = df.withColumn("__patterns", F.filter(s["patterns"], lambda p: hit(p["rel"]) | both(p)))
    df = df.withColumn("__nodes", _connected(s, F.col("__nodes"), F.col("__patterns")))
    return _or_whole(df, s, (F.size(q) > 0) & ~((F.size("__nodes") < min_nodes) & (F.size("__patterns") == 0)), out).drop("__tokens")


def _or_whole(df: DataFrame, s: Column, ok: Column, out: str) -> DataFrame:
    small = F.struct(F.col("__nodes").alias("nodes"), F.col("__rels").alias("rel_props"), F.col("__patterns").alias("patterns"), s["raw"].alias("raw"), F.lit(True).alias("parsed"))
    return df.withColumn(out, F.when(s["parsed"] & ok, small).otherwise(s)).drop("__nodes", "__rels", "__patterns")


def element_names(schema: Column, kind: str) -> Column:
    """The distinct labels, rel_types or properties of a parsed schema."""
    if kind == "labels":
        return F.transform(schema["nodes"], lambda x: x["label"])
    if kind == "rel_types":
        return F.array_distinct(F.concat(F.transform(schema["rel_props"], lambda x: x["label"]), F.transform(schema["patterns"], lambda x: x["rel"])))
    return F.array_distinct(F.flatten(F.transform(F.concat(schema["nodes"], schema["rel_props"]), lambda x: F.transform(x["props"], lambda p: p["name"]))))


def unknown_elements(df: DataFrame, elements: str, schema: str, small: str) -> DataFrame:
    """Adds for each kind of element how many of a query's are not in the schema (unknown_<kind>), and how many of those that are in it its
    pruned part has lost (missing_<kind>); full_<kind> is what the schema has."""
    for k in ("labels", "rel_types", "properties"):
        df = df.withColumn(f"full_{k}", element_names(F.col(schema), k))
        lost = F.array_except(F.array_intersect(F.col(f"{elements}.{k}"), F.col(f"full_{k}")), element_names(F.col(small), k))
        df = df.withColumns({f"missing_{k}": F.size(lost), f"unknown_{k}": F.size(F.array_except(F.col(f"{elements}.{k}"), F.col(f"full_{k}")))})
    return df


def prune_by_score(df: DataFrame, schema: str, scores: str, out: str, threshold: float = 0.45) -> DataFrame:
    """Like prune(), by scores of an outside encoder: a map from `kind|owner|name` (node, node_prop, rel, rel_prop) to a similarity."""
    s, m = F.col(schema), F.col(scores)
    score = lambda kind, owner, name: F.coalesce(F.element_at(m, F.concat_ws("|", F.lit(kind), owner, name)), F.lit(-1.0)) >= threshold
    part = lambda kind: (lambda x: score(kind, x["label"], x["label"]), lambda x, p: score(f"{kind}_prop", x["label"], p["name"]))
    df = df.withColumn("__nodes", _kept(s["nodes"], *part("node"))).withColumn("__rels", _kept(s["rel_props"], *part("rel")))
    labels, rels = F.transform(F.col("__nodes"), lambda x: x["label"]), F.transform(F.col("__rels"), lambda x: x["label"])
    df = df.withColumn("__patterns", F.filter(s["patterns"], lambda p: F.array_contains(rels, p["rel"]) | (F.array_contains(labels, p["src"]) & F.array_contains(labels, p["dst"]))))
    df = df.withColumn("__nodes", _connected(s, F.col("__nodes"), F.col("__patterns")))
    return _or_whole(df, s, ~((F.size("__nodes") == 0) & (F.size("__patterns") == 0)), out)


def apply_mode(df: DataFrame, text: str, question: str, mode: str, out: str, min_nodes: int = 1, scores: str | None = None) -> DataFrame:
    """Adds the schema's text in one of MODES. similarity without scores falls back to exact_match."""
    if mode not in MODES:
        raise ValueError(f"unknown schema mode: {mode}")
    raw = F.coalesce(F.col(text), F.lit(""))
    if mode in ("none", "enhanced"):
        return df.withColumn(out, F.lit("") if mode == "none" else raw)
    df = parsed(df, text, "__schema")
    if mode == "base":
        return df.withColumn(out, render(F.col("__schema"), examples=False)).drop("__schema")
    if mode == "similarity" and scores:
        df = prune_by_score(df, "__schema", scores, "__small")
    else:
        asked = ner_mask(F.col(question)) if mode == "ner_exact_match" else F.col(question)
        df = prune(df.withColumn("__asked", asked), "__schema", "__asked", "__small", min_nodes).drop("__asked")
    return df.withColumn(out, render(F.col("__small"))).drop("__schema", "__small")


def trim(df: DataFrame, text: str, drop: Column, out: str) -> DataFrame:
    """Adds a schema's text without property lines from the bottom, until drop characters are gone; lines from `The relationships` on stay,
    and a mark follows. Steps that are used more than once are columns of their own."""
    df = df.withColumns({"__rows": lines(F.col(text)), "__drop": drop})
    rows = F.col("__rows")
    at = F.array_position(F.transform(rows, lambda l: strip(l).rlike(PATTERN_SECTION)), F.lit(True))
    df = df.withColumn("__at", at).withColumn("__guarded", F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(F.size(rows)).cast("int"))
    marked = F.reverse(F.transform(rows, lambda l, i: F.struct(l.alias("l"), ((i < F.col("__guarded")) & l.rlike(PROPERTY_LINE)).alias("r"))))
    kind = "struct<gone:int,n:int,kept:array<string>>"

    def step(acc, x):
        go = x["r"] & (acc["gone"] < F.col("__drop"))
        return F.struct(F.when(go, acc["gone"] + F.length(x["l"]) + 1).otherwise(acc["gone"]).alias("gone"), (acc["n"] + go.cast("int")).alias("n"), F.when(go, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["l"]))).alias("kept")).cast(kind)

    start = F.struct(F.lit(0).alias("gone"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")).cast(kind)
    df = df.withColumn("__done", F.aggregate(marked, start, step)).withColumn("__kept", F.reverse("__done.kept"))
    df = df.withColumn("__place", F.least("__guarded", F.size("__kept")))
    with_mark = F.concat(F.slice("__kept", F.lit(1), F.col("__place")), F.array(F.lit(TRUNCATED)), F.slice("__kept", F.col("__place") + 1, F.size("__kept")))
    new = F.array_join(F.when(F.col("__done.n") > 0, with_mark).otherwise(F.col("__kept")), "\n")
    same = (F.col("__drop") <= 0) | (F.col(text) == "")
    return df.withColumn(out, F.when(same, F.col(text)).otherwise(new)).drop("__rows", "__drop", "__at", "__guarded", "__done", "__kept", "__place")


def fit_prompt(df: DataFrame, schema: str, question: str, reserve: Column, budget: int, attempts: int = 5, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds prompt, prompt_tokens, schema_text, schema_chars_untrimmed, schema_trimmed and over_budget: the schema is trimmed until prompt and
    reserve fit, in at most `attempts` renderings. count: tokens of a prompt, by default those of the query tokeniser.

    The loop is unrolled, a projection each, so it stays one stage without Python.
    """
    count = count or (lambda p: F.size(tokens(p)))
    df = df.withColumns({"schema_text": F.coalesce(F.col(schema), F.lit("")), "schema_trimmed": F.lit(False), "over_budget": F.lit(False), "__fits": F.lit(False), "prompt": F.lit(""), "prompt_tokens": F.lit(0)})
    df = df.withColumn("schema_chars_untrimmed", F.length("schema_text"))
    for k in range(attempts):
        df = df.withColumn("prompt", F.when(F.col("__fits"), F.col("prompt")).otherwise(plain_prompt(F.col("schema_text"), F.col(question))))
        df = df.withColumn("prompt_tokens", F.when(F.col("__fits"), F.col("prompt_tokens")).otherwise(count(F.col("prompt"))))
        df = df.withColumn("__over", F.when(F.col("__fits"), 0).otherwise(F.col("prompt_tokens") + reserve - budget))
        df = df.withColumns({"schema_trimmed": F.col("schema_trimmed") | (F.col("__over") > 0), "__fits": F.col("__fits") | (F.col("__over") <= 0)})
        if k == attempts - 1:
            df = df.withColumn("over_budget", ~F.col("__fits"))
        else:  # what fits has nothing over and stays as it is
            df = trim(df, "schema_text", F.when(F.col("__over") > 0, F.floor(F.col("__over") * 3.5).cast("int") + 64).otherwise(0), "schema_text")
    return df.drop("__fits", "__over")
