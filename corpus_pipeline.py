"""From raw documents to packed training sequences: STAGES, each written as Parquet and read again as the next one's docs.

All stages read whole texts and every row. They expect columns doc_id, text, lang and source; other columns go along up to packing,
whatever their names. An empty table gives an empty result in each.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.common import Shelter, bound_batches, materialise, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.packing import pack

#: A document whose best language is less probable than this is rejected.
LEAST_SCORE = 0.5
#: Bytes of an Arrow batch: executors come to each stage with the heap and the workers that the stages before have grown.
BATCH_BYTES = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the classifier, fitted on the labels of docs, is sure of. Without labels: all with a letter.

    A null or empty text, or one without a letter, goes. A null lang is a document without a label; a null id isn't special. Rows
    that repeat have one verdict. A text of any length is scored whole. Columns named lang_pred or score are the input's own.
    """
    bound_batches(spark, BATCH_BYTES)
    model = langid.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    s = Shelter(docs)
    found = langid.predict(s.df, model, text_col=s("text"))
    return s.back(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id.

    A null text counts as empty, and all empty texts are one group. A null id is smaller than all others. Of rows that tie in text and id
    one stays. Texts are equal if identical to the last byte, whatever their length. Columns named as the operator's are the input's own.
    """
    s = Shelter(docs)
    return s.back(exact_dedup(s.df, s("doc_id"), s("text")).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Decided by row: of rows that share an id only those go whose own text is a near copy. Null, empty and wordless texts and rows with a
    null id all stay. Of rows that repeat with id and text one stays. A text with under five words is one shingle.
    """
    bound_batches(spark, BATCH_BYTES)
    return drop_near_duplicates(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times, 0 to 2, as the mix has copies of it.

    A null source is a source of its own. A text without words, or null, has size 0 and stays once. Rows that agree in id and size have the
    same copies; reruns agree. Columns named as the operator's are the input's own.
    """
    s = Shelter(docs)
    mixed = mix(s.df, s("doc_id"), s("text"), s("source")).filter("copies > 0")
    return s.back(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens, with their token ids (little-endian unsigned 32-bit).

    A null or empty text has its end id alone. Rows that repeat are packed each for itself; a null id stays null. A text of any length
    is cut into windows. Columns but doc_id and text are not read.
    """
    bound_batches(spark, BATCH_BYTES)
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The classifier, the rates and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
