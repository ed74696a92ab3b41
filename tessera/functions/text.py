"""Identifiers, questions, prompts and answers, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tokens import strip

#: Fixed values.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "with", "by", "what", "which", "who", "whom", "how", "many", "much", "list",
    "show", "give", "find", "get", "all", "are", "is", "was", "were", "be", "have", "has", "had", "return", "count", "most", "least", "top",
    "there", "their", "that", "this", "from", "as", "at", "it", "do", "does", "did", "me", "please", "name", "names",
)
STARTERS = ("match", "merge", "create", "call", "with", "unwind", "return", "optional", "detach", "load", "use", "profile", "explain", "set", "delete", "remove", "foreach")
STOP_MARKERS = ("<|im_end|>", "<end_of_turn>", "<|endoftext|>", "<eos>", "<|eot_id|>")
ALIAS_PREFIXES = ("neo4jlabs_demo_db_", "neo4jlabs_demo_", "neo4j_demo_", "demo_db_")
FATAL_CONNECTION = ("authentication", "unauthorized", "cannot resolve", "unable to retrieve routing")
TRANSIENT_CONNECTION = ("serviceunavailable", "sessionexpired", "connection refused", "connection reset", "failed to establish connection")
SYSTEM = (
    "Task: Generate Cypher statement to query a graph database.\n"
    "Instructions: Use only the provided relationship types and properties in the schema. "
    "Do not use any other relationship types or properties that are not provided in the schema. "
    "Do not include any explanations or apologies in your responses. "
    "Do not respond to any questions that might ask anything else than for you to construct "
    "a Cypher statement. Do not include any text except the generated Cypher statement."
)
USER = (
    "Generate Cypher statement to query a graph database.\n"
    "Use only the provided relationship types and properties in the schema.\n"
    "Schema: %s\nQuestion: %s\nCypher output:"
)


def identifier_pieces(c: Column) -> Column:
    """The searchable parts of an identifier: itself, its chunks between _ - . and white space, their camel-case parts; lower case, over one letter."""
    term = strip(F.coalesce(c, F.lit("")))
    chunk = lambda x: F.concat(F.array(F.lower(x)), F.transform(F.split(x, r"(?<=[a-z0-9])(?=[A-Z])"), lambda y: F.lower(y)))
    parts = F.concat(F.array(F.lower(term)), F.flatten(F.transform(F.split(term, r"[_\-\s.]+"), chunk)))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1))


def question_tokens(c: Column) -> Column:
    """Searchable words of a question: identifier parts of all but stop words, and a guess at the singular."""
    words = F.filter(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP_WORDS))

    def one(w):
        low = F.lower(w)
        n = F.length(low)
        single = (
            F.when(low.endswith("ies") & (n > 4), F.concat(F.left(low, n - 3), F.lit("y")))
            .when(low.endswith("ses") & (n > 4), F.left(low, n - 2))
            .when(low.endswith("s") & ~low.endswith("ss") & (n > 3), F.left(low, n - 1)))
        return F.array_compact(F.concat(identifier_pieces(w), F.array(single)))

    return F.array_distinct(F.flatten(F.transform(words, one)))


#: What is masked in a question.
SPAN = r"[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|of|the|and|de|van))*"
QUOTED, NUMBER = r"\"[^\"]*\"|'[^']*'", r"\b\d[\d,.]*\b"
#: Reasoning, fences and lead-ins around a query.
THOUGHT, THOUGHT_END = r"(?is)<think>.*?</think>", r"(?is)\A.*?</think>"
FENCE = r"(?is)```(?:cypher|cql|sql|text)?\s*(.*?)```"
LEAD_IN = r"(?i)\A\s*(cypher\s*(query|statement|output)?\s*:|output\s*:|answer\s*:)\s*"


#: A later span of a question, by the same rule as its first.
LONGER_SPAN = r"\b(?:[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|of|the|and|de|van))+|[A-Z][a-z]{3,})\b"


def ner_mask(c: Column) -> Column:
    """Quoted text and title-case spans (of two words, or of over three letters, and not at the start) as ENTITY, numbers as NUMBER."""
    masked = F.regexp_replace(F.coalesce(c, F.lit("")), QUOTED, " ENTITY ")
    masked = F.regexp_replace(masked, NUMBER, " NUMBER ")
    first = F.regexp_extract(masked, rf"\A{SPAN}\b", 0)
    rest = F.substring(masked, F.length(first) + 1, F.length(masked))
    # whatever follows a span at the start begins after a word boundary, as it does in the whole text
    return F.concat(first, F.regexp_replace(rest, LONGER_SPAN, " ENTITY "))


def extract_answer(c: Column) -> Column:
    """The query in a model's raw output: without reasoning, fences, lead-ins and remarks around it."""
    text = F.coalesce(c, F.lit(""))
    for marker in STOP_MARKERS:
        text = F.substring_index(text, marker, 1)
    text = F.regexp_replace(text, THOUGHT, " ")
    text = F.regexp_replace(text, THOUGHT_END, "")
    text = F.replace(text, F.lit("<think>"), F.lit(" "))
    text = strip(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text))
    text = F.regexp_replace(text, LEAD_IN, "")
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda b: b != "")
    starts = F.filter(blocks, lambda b: F.lower(F.regexp_replace(F.substring_index(b, " ", 1), r"\A[`(]+|[`(]+\z", "")).isin(*STARTERS))
    chosen = F.coalesce(F.get(starts, F.lit(0)), F.get(blocks, F.lit(0)), F.lit(""))
    chosen = strip(F.regexp_replace(strip(chosen), r"\A`+|`+\z", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(chosen, r"\s+\z", ""), r";+\z", ""), r"\s+\z", "")


def user_prompt(schema: Column, question: Column) -> Column:
    return F.format_string(USER, F.coalesce(schema, F.lit("")), F.coalesce(question, F.lit("")))


def messages(schema: Column, question: Column, system_role: bool = True) -> Column:
    """Chat turns as structs of role and content; without a system role its text opens the user's turn."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = user_prompt(schema, question)
    if system_role:
        return F.array(turn("system", F.lit(SYSTEM)), turn("user", user))
    return F.array(turn("user", F.concat(F.lit(f"{SYSTEM}\n\n"), user)))


def plain_prompt(schema: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{SYSTEM}\n\n"), user_prompt(schema, question))


def strip_leading(c: Column, mark: str) -> Column:
    return F.when(c.startswith(mark), F.substring(c, len(mark) + 1, 2**31 - 1)).otherwise(c)


def alias_to_database(c: Column) -> Column:
    """A database's name from its alias; null for none."""
    name = F.regexp_replace(strip(c), rf"\A(?:{'|'.join(ALIAS_PREFIXES)})", "")
    name = F.regexp_replace(name, r"\A[_\- ]+|[_\- ]+\z", "")
    return F.nullif(name, F.lit(""))


def connection_trouble(c: Column) -> Column:
    """What an error message says of the connection: `fatal` (no further call can succeed), `transient` or null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("|".join(FATAL_CONNECTION)), "fatal").when(low.rlike("|".join(TRANSIENT_CONNECTION)), "transient")


def is_connectivity_error(c: Column) -> Column:
    return connection_trouble(c).isNotNull()


def is_ordered(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)\border\s+by\b")
