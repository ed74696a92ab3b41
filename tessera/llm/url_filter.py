"""URL rules, and trust and distrust that spread over host edges for the URLs that no rule fits."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, Shelter, ascii_lower, discard, materialise, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Mass that starts at the seeds, in whole units; percent that follows edges; a host is blocked if distrust * 100 > trust * LEAST.
MASS, DAMPING, LEAST = 10**12, 85, 100
#: Share of the mass that may be on its way still when the rounds end, and the rounds that this takes.
TOLERANCE = 0.02
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING / 100))
#: Edges of a host that one copy of its scores meets, about; characters that a host name may have at most (RFC 1035), beyond which there are
#: no hosts above it.
SALT, LONGEST = 4096, 253
LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']?(?:https?:)?//([^"'\s>/?#]*)"""


def host_and_path(url):
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host, path, rules=RULES):
    """The longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out


def _above(host):
    """Pairs of each host and the one above it, from the host up to the last with two labels; none past an empty label."""
    labels = F.split(host, r"\.")
    n, gap = F.size(labels), F.array_position(labels, "")
    steps = F.least(n - 2, F.when(gap > 0, gap.cast("int") - 1).otherwise(n))
    name = lambda i: F.array_join(F.slice(labels, i, n), ".")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), steps)), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    return F.when((steps >= 1) & (F.length(host) <= LONGEST), pairs)


def host_trust(pages: DataFrame, rules=RULES) -> DataFrame:
    """trust and distrust of every host; pages: host, rule, html.

    Edges: links to other hosts in the pages' anchors, and between a host and each host above it, at any depth, both ways. Trust is a
    personalised PageRank that starts from hosts by their number of allowed pages and follows edges; distrust starts from blocked pages and
    follows edges backwards. All are whole numbers, divided downwards, so any order of summing gives the same. ROUNDS leave a share of
    TOLERANCE at most unspread. Tables are written to the shared folder each round. Repeated links count once. A host with many
    edges meets its scores in as many tasks as it has SALTs of them.
    """
    allowed = [r for v, r in rules if v == "allow"]
    seen = pages.filter("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("rule").isin(allowed), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("rule").isNotNull() & ~F.col("rule").isin(allowed), 1).otherwise(0)).alias("bad"))
    seen = materialise(seen, "hosts")
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("dst <> '' and src <> dst").distinct()
    links = materialise(links, "links")
    known = seen.select("host").union(links.select("dst")).distinct()
    up = known.select(F.explode(_above(F.col("host"))).alias("e")).select("e.src", "e.dst").distinct()
    edges = materialise(links.union(up).union(up.select("dst", "src")).distinct(), "edges")
    # trust flows along edges, distrust back: one table of both, by the host that gives
    flows = edges.select(F.col("src").alias("giver"), F.col("dst").alias("taker"), F.lit(0).alias("kind")).union(edges.select("dst", "src", F.lit(1)))
    degree = materialise(flows.groupBy("giver", "kind").agg(F.count(F.lit(1)).alias("n")), "degrees")
    total = seen.agg(F.sum("good").alias("good_sum"), F.sum("bad").alias("bad_sum"))
    start = seen.join(F.broadcast(total)).select("host", F.expr(f"coalesce(good * {MASS} div nullif(good_sum, 0), 0)").alias("t0"), F.expr(f"coalesce(bad * {MASS} div nullif(bad_sum, 0), 0)").alias("d0"))
    start = start.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t0").alias("first")), F.struct(F.lit(1).alias("kind"), F.col("d0").alias("first")))).alias("x")).select("host", "x.kind", "x.first")
    base = degree.select(F.col("giver").alias("host"), "kind", F.lit(0).cast("long").alias("first"), "n").union(start.select("host", "kind", "first", F.lit(0).cast("long")))
    rank = materialise(base.groupBy("host", "kind").agg(F.sum("first").alias("first"), F.sum("n").alias("n")).withColumn("mass", F.col("first")), "rank")
    salts = F.expr(f"n div {SALT}")
    flows = flows.join(degree, ["giver", "kind"]).select("giver", "taker", "kind", F.pmod(F.xxhash64("taker"), salts + 1).alias("salt"))
    flows = materialise(flows, "flows")
    for _ in range(ROUNDS):
        give = rank.filter("n > 0 and mass >= n").select(F.col("host").alias("giver"), "kind", F.expr("mass div n").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"))
        got = flows.join(give, ["giver", "kind", "salt"]).groupBy(F.col("taker").alias("to"), F.col("kind").alias("k")).agg(F.sum("part").alias("got"))
        new = F.expr(f"({100 - DAMPING} * first + {DAMPING} * coalesce(got, 0)) div 100")
        old, rank = rank, materialise(rank.join(got, (F.col("host") == F.col("to")) & (F.col("kind") == F.col("k")), "left").select("host", "kind", "first", "n", new.alias("mass")), "rank")
        discard(old)
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("mass")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("mass")).otherwise(0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to each row.

    A row that a rule fits has the rule's verdict. For any other, its host is blocked if its distrust is over its trust, see host_trust(),
    and allowed if not; a row without a host is allowed. Null html has no links; html of any length is searched whole. Rows that repeat
    are judged alike. An empty table gives an empty result. Input columns named as added ones, in any case, are replaced.
    """
    s = Shelter(pages)
    host, path = host_and_path(F.col(s(url_col)))
    rows = s.df.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    rank = host_trust(rows.select("host", "rule", F.col(s(html_col)).alias("html")), rules)
    bad = rank.filter(F.col("distrust") * 100 > F.col("trust") * LEAST).select(F.col("host").alias("bad"))
    verdict = F.lit(None).cast("string")
    for v, r in rules:
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    out = rows.join(bad, F.col("host") == F.col("bad"), "left")
    out = out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad").isNotNull(), "block").otherwise("allow")))
    return s.back(out, "host", "path", "rule", "verdict")


def op2_url_filter(spark, sf_dir):
    """Verdicts on all pages' urls."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    parts = [(r, *r.partition("/")[::2]) for _, r in rules]
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r, h, p in parts)
    allowed = ", ".join(f"'{r}'" for v, r in RULES if v == "allow")
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
    lower = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    up = r"nullif(regexp_extract({}, '^[^.]+\.(.*\..*)$', 1), '')"
    q = rf"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
g AS (SELECT page_id, html, translate(raw, {lower}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
r AS (SELECT *, CASE {case} END AS rule FROM g),
seen AS (SELECT host, sum(CASE WHEN rule IN ({allowed}) THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN rule IS NOT NULL AND rule NOT IN ({allowed}) THEN 1 ELSE 0 END)::BIGINT AS bad FROM r WHERE host <> '' GROUP BY host),
l0 AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS dst FROM r WHERE host <> ''),
links AS (SELECT DISTINCT src, dst FROM l0 WHERE dst <> '' AND src <> dst),
known AS (SELECT host FROM seen UNION SELECT dst FROM links),
c0 AS (SELECT host, CASE WHEN length(host) <= {LONGEST} THEN {up.format('host')} END AS above FROM known UNION SELECT above, {up.format('above')} FROM c0 WHERE above IS NOT NULL),
chain AS (SELECT host, above FROM c0 WHERE above IS NOT NULL),
e0 AS (SELECT src, dst FROM links UNION SELECT host, above FROM chain UNION SELECT above, host FROM chain),
edges AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS outs, count(*) OVER (PARTITION BY dst) AS ins FROM e0),
base AS MATERIALIZED (
  SELECT n.host, coalesce(good * {MASS} // nullif((SELECT sum(good)::BIGINT FROM seen), 0), 0)::BIGINT AS t0, coalesce(bad * {MASS} // nullif((SELECT sum(bad)::BIGINT FROM seen), 0), 0)::BIGINT AS d0
  FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seen) n LEFT JOIN seen s ON n.host = s.host),
k0 AS (SELECT host, t0 AS t, d0 AS d FROM base)"""
    for i in range(ROUNDS):
        q += f""",
k{i + 1} AS MATERIALIZED (
  SELECT b.host, ({100 - DAMPING} * t0 + {DAMPING} * coalesce(x.t, 0)) // 100 AS t, ({100 - DAMPING} * d0 + {DAMPING} * coalesce(y.d, 0)) // 100 AS d FROM base b
  LEFT JOIN (SELECT dst AS host, sum(t // outs)::BIGINT AS t FROM edges JOIN k{i} ON src = host GROUP BY dst) x ON b.host = x.host
  LEFT JOIN (SELECT src AS host, sum(d // ins)::BIGINT AS d FROM edges JOIN k{i} ON dst = host GROUP BY src) y ON b.host = y.host)"""
    return q + f"""
SELECT page_id, coalesce(r.host, '') AS host, coalesce(path, '') AS path, rule, CASE {verdict} WHEN k.d * 100 > k.t * {LEAST} THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN k{ROUNDS} k ON r.host = k.host
"""


OP2_SQL = _sql()
