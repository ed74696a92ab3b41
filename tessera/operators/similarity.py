"""Threshold joins of vectors within groups, and schemas pruned by the similarity of their elements to a question."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.schema import parsed, prune_by_score, render

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Questions whose vectors are multiplied with a group's elements at a time.
BLOCK = 512


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite numbers, not all 0."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column, i: int) -> tuple[pa.Array, np.ndarray]:
    """Names and normalised vectors of one row's list of (name, vector)."""
    own = column[i].values
    vectors = own.field("vector")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
    return own.field("name"), m / np.linalg.norm(m, axis=1, keepdims=True)


def _products(threshold: float):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (q, a), (e, m) = _unit(b.column(0), i), _unit(b.column(1), i)
                scores = a @ m.T
                x, y = np.nonzero(scores >= threshold)
                if len(x):
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(x)), e.take(pa.array(y)), pa.array(scores[x, y])], ["question", "element", "score"])

    return run


def similar(questions: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """question, element and score (cosine) of pairs within a group whose score is threshold or more.

    questions has question, group and vector, elements has group, element and vector. A group's elements, a schema's, are one matrix of
    bounded size and come once; its questions, however many, are dealt to blocks of about BLOCK, each of which meets that matrix in one
    product, so a group that most questions share is spread over as many tasks as it needs. Vectors that are null, hold null or
    non-finite components or are all 0 take no part, nor do those of another length than the other side's.
    """
    q = questions.filter(_usable(F.col("vector"))).select("group", F.size("vector").alias("dim"), F.struct(F.col("question").alias("name"), "vector").alias("x"))
    e = elements.filter(_usable(F.col("vector"))).select("group", F.size("vector").alias("dim"), F.struct(F.col("element").cast("string").alias("name"), "vector").alias("x"))
    blocks = q.groupBy("group", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = q.join(blocks, ["group", "dim"]).withColumn("block", F.pmod(F.xxhash64("x.name"), F.col("blocks")).cast("int"))
    left = dealt.groupBy("group", "dim", "block").agg(F.collect_list("x").alias("questions"))
    matrix = e.groupBy("group", "dim").agg(F.collect_list("x").alias("elements")).join(blocks, ["group", "dim"])
    right = matrix.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    kind = questions.schema["question"].dataType.simpleString()
    return left.join(right, ["group", "dim", "block"]).select("questions", "elements").mapInArrow(_products(threshold), f"question {kind}, element string, score double")


def schema_elements(texts: DataFrame, text: str) -> DataFrame:
    """One row for each element of each text's schema: text, element (`kind|owner|name`) and name, what an encoder is given."""
    s = parsed(texts.select(F.col(text).alias("text")), "text", "s")

    def of(kind: str, owners: str) -> DataFrame:
        o = s.select("text", F.explode(f"s.{owners}").alias("o"))
        own = F.struct(F.concat_ws("|", F.lit(kind), "o.label", "o.label").alias("element"), F.col("o.label").alias("name"))
        props = F.transform("o.props", lambda p: F.struct(F.concat_ws("|", F.lit(f"{kind}_prop"), "o.label", p["name"]).alias("element"), F.concat_ws(" ", "o.label", p["name"]).alias("name")))
        return o.select("text", F.explode(F.concat(F.array(own), props)).alias("x")).select("text", "x.element", "x.name")

    return of("node", "nodes").unionByName(of("rel", "rel_props"))


def prune_by_vectors(rows: DataFrame, key: str, text: str, vector: str, vectors: DataFrame, out: str, threshold: float = 0.45) -> DataFrame:
    """Adds the schema's text with the elements whose vectors are like the row's question's, given by column vector.

    vectors (name, vector) has an outside encoder's vector of each element's name; the elements of a schema that many rows share are looked
    up and multiplied once a block of these. An element without a vector isn't kept. If nothing is left, or the schema can't be parsed, it stays
    whole; so it does for a question without a vector.
    """
    texts = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    group = F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("group")
    elements = schema_elements(texts, "text").join(vectors.select("name", "vector"), "name").select(group, "element", "vector")
    questions = rows.select(F.col(key).alias("question"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(vector).alias("vector")).select("question", group, "vector")
    found = similar(questions, elements, threshold).groupBy(F.col("question").alias("__question")).agg(F.map_from_entries(F.collect_list(F.struct("element", "score"))).alias("__scores"))
    scored = rows.join(found, F.col(key) == F.col("__question"), "left").drop("__question")
    scored = parsed(scored.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text", "__schema")
    small = prune_by_score(scored.withColumn("__scores", F.coalesce("__scores", F.create_map().cast("map<string,double>"))), "__schema", "__scores", "__small", threshold)
    return small.withColumn(out, render(F.col("__small"))).drop("__schema", "__small", "__scores", "__text")
