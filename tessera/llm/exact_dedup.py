"""Exact duplicates by two passes of a Bloom filter: only rows that may be repeated are shuffled."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Shelter, materialise, table

#: Slots of one block of the filter, hashes that it gets on average, and slots that a hash sets (all in its own block).
BLOCK_SLOTS, BLOCK_HASHES, PROBES = 1 << 13, 1 << 10, 4
#: Blocks of one filter that is broadcast: 64 MB at most. More hashes are worked through in slices, each with its own filter.
SLICE_BLOCKS = 1 << 16


def _slots(fp: np.ndarray) -> np.ndarray:
    """The slots of 64-bit hashes in their block, one row a probe."""
    return np.stack([(fp >> np.uint64(13 * i)) & np.uint64(BLOCK_SLOTS - 1) for i in range(PROBES)]).astype(np.int64)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(52)) * np.uint64(blocks) >> np.uint64(12)).astype(np.int64) if blocks <= 4096 else ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _gather(blocks: int):
    def run(batches):
        kept: list[np.ndarray] = []
        seen = 0

        def out():
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            h = np.concatenate([h, h[n > 1]])  # a hash that this task has seen twice counts as two
            block = _block(h, blocks)
            order = np.argsort(block, kind="stable")
            h, block = h[order], block[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            parts = np.split(h, at[1:])
            return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "hashes"])

        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if len(h):
                kept.append(h)
                seen += len(h)
            if seen >= 1 << 20:
                yield out()
                kept, seen = [], 0
        if kept:
            yield out()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The slots of a block that two hashes or more have set."""
    count = np.zeros(BLOCK_SLOTS, np.uint8)
    for x in pdf["hashes"]:
        h = np.frombuffer(x, np.uint64)
        for s in _slots(h):
            count = np.minimum(count + np.minimum(np.bincount(s, minlength=BLOCK_SLOTS), 2), 2).astype(np.uint8)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(count >= 2).tobytes()]})


def _tester(sent, blocks: int):
    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        h = h.to_numpy().astype(np.int64).view(np.uint64)
        bits, block = sent.value, _block(h, blocks)
        hit = np.ones(len(h), bool)
        for s in _slots(h):
            hit &= (bits[block, s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    return repeated


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha_col: str | None = None) -> DataFrame:
    """Adds text_sha256, keep_id, group_size and kept to each row; of equal texts the row with the largest id is kept.

    First pass: each task gathers the 64-bit hashes of its own texts by block of a counting Bloom filter; a block's hashes meet in one
    task (about BLOCK_HASHES of them, and two at most from each task for a text repeated without end), which keeps the slots that were
    set twice. Second pass: a row is shuffled only if all its slots are among these; all others stay where they are. What is shuffled is
    grouped by the full SHA-256, so false positives cost time and change nothing. sha_col: a column that has the text's SHA-256
    already, in lowercase hex; the text is then not read.

    A null text counts as empty. A null id is smaller than all others; if all ids of a group are null, keep_id is null and one row
    is kept. Of rows with the same text and the same largest id, one is kept. An empty table gives an empty result. Input columns
    named as added ones, in any case, are replaced.
    """
    s = Shelter(docs)
    i = s(id_col)
    sha = F.col(s(sha_col)) if sha_col else F.sha2(F.encode(F.coalesce(F.col(s(text_col)), F.lit("")), "UTF-8"), 256)
    added = ("keep_id", "group_size", "kept", "text_sha256")
    # ties of text and id are broken by the other columns
    order = [f"c{k}" for k, (c, t) in enumerate(docs.dtypes) if "map<" not in t and "variant" not in t and c.lower() not in added and f"c{k}" not in (i, s(sha_col or text_col))]
    spark, kind = docs.sparkSession, dict(s.df.dtypes)[i]
    n = docs.count()
    slices = max(1, -(-n // (BLOCK_HASHES * SLICE_BLOCKS)))
    blocks = max(1, min(SLICE_BLOCKS, -(-n // (BLOCK_HASHES * slices))))
    rows = s.df.withColumn("text_sha256", sha).withColumn("h", F.xxhash64("text_sha256"))
    out = None
    for k in range(slices):
        part = rows if slices == 1 else rows.filter(F.pmod(F.xxhash64("h"), F.lit(slices)) == k)
        spread = part.select("h").mapInArrow(_gather(blocks), "block long, hashes binary")
        made = spread.groupBy("block").applyInPandas(_merge, "block long, bits binary").toArrow()
        bits = np.zeros((blocks, BLOCK_SLOTS // 8), np.uint8)
        for b, x in zip(made.column(0).to_numpy(), made.column(1).to_pylist(), strict=True):
            bits[b] = np.frombuffer(x, np.uint8)
        sent = spark.sparkContext.broadcast(bits)

        repeated = _tester(sent, blocks)
        marked = part.withColumn("hit", repeated("h"))
        alone = marked.filter(~F.col("hit")).withColumns({"keep_id": F.col(i), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
        may = marked.filter("hit")
        groups = may.groupBy(F.col("text_sha256").alias("g"), F.col(i).alias("i")).agg(F.count(F.lit(1)).alias("c"))
        groups = groups.groupBy("g").agg(F.max("i").alias("keep"), F.sum("c").alias("size"), F.coalesce(F.max_by("c", "i"), F.sum("c")).alias("top"))
        joined = may.join(groups, F.col("text_sha256") == F.col("g")).withColumns({"keep_id": F.col("keep").cast(kind), "group_size": F.col("size").cast("long"), "kept": F.col(i).eqNullSafe(F.col("keep"))})
        top = F.col("kept") & (F.col("top") > 1)
        # Spark runs the window over the few rows that share text and id with the kept one
        place = F.row_number().over(Window.partitionBy("g").orderBy(*order, F.lit(0)))
        ties = joined.filter(top).withColumn("kept", place == 1)
        both = alone.unionByName(joined.filter(~top).unionByName(ties).drop("g", "keep", "size", "top"))
        out = both if out is None else out.unionByName(both)
    return s.back(out, *added)


def op8_exact_dedup(spark, sf_dir):
    """Groups of equal texts among all documents, one row a document. Texts are read and hashed once, into a table of ids and hashes."""
    sha = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)
    keys = materialise(table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha")), "keys")
    return exact_dedup(keys, sha_col="sha").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
