"""Exact top-k inner products by norm buckets: whole buckets are skipped, or searched by length or by coordinates."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

#: Ratio of lengths within a bucket; vectors of one searched part and queries of one block, about; longest vectors, and others by hash, that give first thresholds.
RATIO, PART, BLOCK, SEEDS = 1.05, 8192, 8192, 1024
#: From this local cosine threshold on, coordinates prune; how many of the largest are looked at.
COSINE, FOCUS = 0.6, 3
_EXACT = 2.0**20
#: Queries whose products with a part are held at a time.
_ROWS = 256


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, kept in float64 where that holds them; else in Python integers, cut to 64 bits."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)))
    if np.abs(q).max() < _EXACT and np.abs(c).max() < _EXACT and q.shape[1] <= 4096:
        return q @ c.T
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    return np.clip(big, -(2**63), 2**63 - 1)


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def search(q, theta, qid, c, cid, k: int, found):
    """Finds the k best of c (ties to the smaller id) for each query among scores of at least theta, and calls found(query, ids, scores).

    c holds vectors of one length bucket. With l its greatest length, a query needs a cosine of theta / (|q| l) here. Over 1: the bucket
    is skipped. From COSINE on: a vector can be that near only if each of its coordinates lies in a range around the query's; the
    ranges of the FOCUS largest coordinates, looked up in sorted lists, leave candidates. Else: all vectors of at least length
    theta / |q|. Only exact products decide.
    """
    order = np.argsort(cid, kind="stable")
    c, cid = c[order], cid[order]
    length, qn = np.sqrt((c * c).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    top = length.max() if len(length) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(qn * top > 0, theta / (qn * top), np.where(theta > 0, np.inf, -np.inf))
    local = np.where(np.isneginf(theta), -np.inf, local) * (1 - 1e-9)
    unit = c / np.where(length > 0, length, 1)[:, None]
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def best(i, at, score):
        ok = (score >= theta[i]) & (cid[at] != qid[i])
        at, score = at[ok], score[ok]
        if len(at) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            above, tie = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
            pick = np.concatenate([above, tie[: k - len(above)]])  # places are in the order of ids
            at, score = at[pick], score[pick]
        if len(at):
            found(i, cid[at], score)

    for i in np.flatnonzero((local >= COSINE) & (local <= 1)):
        u, t = q[i] / qn[i], min(1.0, local[i])
        focus = np.argsort(-np.abs(u))[:FOCUS]
        at = None
        for f in focus.tolist():
            wide = math.sqrt(max(0.0, (1 - u[f] * u[f]) * (1 - t * t)))
            lo = -1.0 if u[f] <= -t else u[f] * t - wide
            hi = 1.0 if u[f] >= t else u[f] * t + wide
            lo, hi = lo - 1e-9, hi + 1e-9
            if at is None:
                if f not in lists:
                    by = np.argsort(unit[:, f])
                    lists[f] = (by, unit[by, f])
                by, values = lists[f]
                at = np.sort(by[np.searchsorted(values, lo) : np.searchsorted(values, hi, side="right")])
            else:
                at = at[(unit[at, f] >= lo) & (unit[at, f] <= hi)]
        best(i, at, products(q[i : i + 1], c[at])[0])
    rest = np.flatnonzero(local < COSINE)
    if len(rest):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(qn[rest] > 0, theta[rest] / qn[rest], -np.inf).min() * (1 - 1e-9)
        at = np.flatnonzero(length >= least)
        for a in range(0, len(rest), _ROWS):
            some = rest[a : a + _ROWS]
            scores = products(q[some], c[at])
            for r, i in enumerate(some.tolist()):
                best(i, at, scores[r])


def _thresholds(seeds, k: int, scale: float):
    def run(batches):
        for b in batches:
            own = np.full(b.num_rows, -np.inf)
            ids, dims = b.column(0).to_numpy(), b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                sid, sv = seeds.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                if len(sid) <= k or not dim:
                    continue
                for a in range(0, len(at), 256):
                    rows = at[a : a + 256]
                    s = products(quantise(_matrix(b.column(1).take(pa.array(rows)), dim), scale), sv).astype(np.float64)
                    s[ids[rows][:, None] == sid[None, :]] = -np.inf
                    own[rows] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], ["id", "vec", "dim", "len", "theta"])

    return run


def _search(k: int, scale: float):
    def run(queries: pa.Table, part: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and part.num_rows:
            dim = queries.column("dim")[0].as_py()
            qid, cid = queries.column("id").to_numpy(), part.column("id").to_numpy()

            def found(i, ids, scores):
                out[0].extend([int(qid[i])] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(int(s) for s in scores)

            search(quantise(_matrix(queries.column("vec"), dim), scale), queries.column("theta").to_numpy(), qid, quantise(_matrix(part.column("vec"), dim), scale), cid, k, found)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k other rows of the highest inner product of floor(scale * x).

    1. The SEEDS longest vectors and SEEDS others (a bounded broadcast) give each query a first threshold: its k-th best product among them. 2. Vectors are
    grouped by length; a bucket is dealt by hash into parts of about PART rows, queries into blocks of about BLOCK. A query is sent only to
    buckets whose longest vector can reach its threshold, and a part only to blocks with such a query. Each part meets each such block
    once, in a task of its own; search() prunes there. 3. Each meeting gives k rows a query at most, none under its threshold.

    Rows with a null id, a null vector or a null, NaN or infinite component take no part. Only vectors of the same dimension are compared.
    Candidates with the query's own id are left out; other rows that repeat are candidates each for itself. An id is one query: where
    its rows differ, that of the fewest and then least components asks. Ties go to the smaller id. Fewer than k candidates: all of them.
    An empty table gives an empty result. Other columns are not read.
    """
    own = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(own).alias("vec"), is_query.alias("q"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine).withColumn("dim", F.size("vec"))
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    level = F.when(F.col("len") > 0, F.floor(F.log("len") / math.log(RATIO))).otherwise(F.lit(-(2**31))).cast("long")
    v = materialise(v.withColumn("len", length).withColumn("level", level), "vectors")
    levels = materialise(v.groupBy("dim", "level").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"), F.max("len").alias("longest")), "levels")

    longest: dict[int, tuple] = {}
    # the others are for queries that face away from the longest; what is in both counts once, or a threshold would be too high
    first = [v.orderBy(*by).select("id", "vec", "dim").limit(SEEDS).collect() for by in ((F.desc("len"), "id"), (F.xxhash64(F.lit(3), "id"), "id"))]
    for i, vec, dim in {(r["id"], tuple(r["vec"]), r["dim"]): None for rows in first for r in rows}:
        longest.setdefault(dim, ([], []))
        longest[dim][0].append(i)
        longest[dim][1].append(vec)
    seeds = v.sparkSession.sparkContext.broadcast({d: (np.array(i), quantise(np.array(x).reshape(len(i), d), scale)) for d, (i, x) in longest.items()})
    asked = v.filter("q").groupBy("id").agg(F.min(F.struct("dim", "vec", "len")).alias("m")).select("id", "m.vec", "m.dim", "m.len")
    asked = asked.mapInArrow(_thresholds(seeds, k, scale), f"id long, vec {own}, dim int, len double, theta double")
    blocks = v.filter("q").groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asked = materialise(asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks"))).drop("blocks"), "queries")
    reach = (asked["dim"] == levels["dim"]) & ((F.col("theta") == F.lit(float("-inf"))) | (F.col("theta") <= F.col("len") * F.col("longest") + F.abs("theta") * 1e-9))
    sent = asked.join(levels, reach).select("id", "vec", asked["dim"], "theta", "level", "block", "parts")
    needed = sent.select("dim", "level", "block", "parts").distinct()
    left = sent.select("id", "vec", "dim", "theta", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block")
    right = v.join(needed, ["dim", "level"]).select("id", "vec", "dim", "level", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "block")
    key = ["dim", "level", "part", "block"]
    left, right = (t.toDF(*t.columns).groupBy(*key) for t in (left, right))
    met = left.cogroup(right).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark, sf_dir):
    """The 5 best of all vectors for each whose id is divisible by 50."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
