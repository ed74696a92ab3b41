"""Importance resampling towards a target: hashed word n-grams weigh documents by how much likelier the target makes them than the corpus."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, SLICE_BYTES, UPPER, Shelter, ddl, materialise, parts_for, table

#: Lower-cases A-Z, and makes a space of each ASCII byte that isn't a letter or a digit. Bytes of other characters belong to words.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))


def words(text: bytes):
    """The words of a text, a slice at a time, so that a long text is never all words at once."""
    rest = b""
    for i in range(0, len(text), SLICE_BYTES):
        part = rest + text[i : i + SLICE_BYTES].translate(_FOLD)
        found = part.split()
        # a word at the slice's end may go on in the next
        rest = found.pop() if found and part[-1] != 32 else b""
        yield from found
    if rest:
        yield rest


def ring(text: bytes, n: int, buckets: int) -> tuple[int, list[int]]:
    """Words, and the buckets of all runs of 1 to n of them, in one scan: the running CRC of the run from each of the last n starts is
    carried on by a space and the next word."""
    crc, count, out = zlib.crc32, 0, []
    if n == 1:  # no start is ever carried on
        out = [crc(w) % buckets for w in words(text)]
        return len(out), out
    open_: list[int] = []
    for w in words(text):
        longer = b" " + w
        open_ = [crc(longer, s) for s in open_[1 - n :]]
        open_.append(crc(w))
        out += [s % buckets for s in open_]
        count += 1
    return count, out


def _bucketed(n: int, buckets: int):
    """Puts words, features and buckets in place of the text, which comes last. Batches are cut so that none holds many long texts' buckets."""

    def run(batches):
        types = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

        def out(t, rows):
            others = t.drop_columns(t.column_names[-1:])
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.Table.from_arrays([*others.columns, *cols], schema=pa.schema([*others.schema, *types])).combine_chunks().to_batches()[0]

        for b in batches:
            t, rows, size, begin = pa.Table.from_batches([b]), [], 0, 0
            for i, text in enumerate(b.column(b.num_columns - 1)):
                raw = text.as_buffer() if text.is_valid else None
                count, found = ring(raw.to_pybytes() if raw is not None else b"", n, buckets)
                rows.append((count, len(found), np.array(found, np.uint32).tobytes() if buckets > 1 << 16 else np.array(found, np.uint16).tobytes()))
                size += len(rows[-1][2])
                if size >= 16 << 20:
                    yield out(t.slice(begin, i + 1 - begin), rows)
                    rows, size, begin = [], 0, i + 1
            if rows:
                yield out(t.slice(begin), rows)

    return run


def _numbers(raw, buckets: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint32 if buckets > 1 << 16 else np.uint16)


def _counted(buckets: int):
    """A task's features by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column(0):
                np.add.at(total, _numbers(raw, buckets), 1)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(bucketed: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket: one number a bucket reaches the driver, whatever the rows."""
    got = bucketed.select("buckets").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the log of its smoothed share in the target over that in the corpus, floored."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(sent, buckets: int):
    """Puts the floored mean gain of its features in place of a row's buckets, which come last."""

    def run(batches):
        for b in batches:
            value, found = sent.value, []
            for raw in b.column(b.num_columns - 1):
                own = _numbers(raw, buckets)
                found.append(int(value[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], names=[*b.schema.names[:-1], "weight"])

    return run


def gumbel(seed: int, key: Column) -> Column:
    """1000 times a Gumbel number drawn by seed and key, floored; the same on each run."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, parts: int, *order: Column) -> DataFrame:
    """Adds rank, from 1 in the given order over all rows: sorted by ranges, with the rows of earlier ranges counted up. No window spans the rows."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its partition
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place})
    dealt = materialise(dealt, "ranges")
    before = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # a row a partition
    before = before.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return dealt.join(before, F.col("__part") == F.col("__p")).withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__p", "__before", "__n")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Puts n_words, n_features, weight, score and rank in place of each row's text; rows with a rank are the draw.

    Features are all runs of 1 to n words of the lower-cased text; a feature's bucket is the CRC-32 of its bytes modulo buckets. One scan of
    a text keeps the running CRCs of the last n starts and writes its buckets to a table (two bytes a feature; four if there are more than
    65,536 buckets); corpus counts, target counts and weights come from that, so texts are read once and never shuffled. A row's weight is
    the mean gain of its features, its score adds a Gumbel number drawn by its id, and of the N rows with least_words words or more the
    floor(percent * N / 100) highest scores are drawn: importance resampling without replacement.

    A null or empty text has no features and weight 0, and isn't drawn unless least_words is 0. A null id draws as an empty one and is
    ranked after the others of its score; rows that share an id share its number; of rows with equal id and score, those earlier in the
    input come first. An empty target counts nothing in any
    bucket. An empty table gives an empty result.
    Input columns named as added ones, in any case, are replaced.
    """
    s = Shelter(docs)
    others = [c for c in s.df.columns if c != s(text_col)]
    key = F.col(s(id_col))
    rows = s.df.select(*others, F.monotonically_increasing_id().alias("__at"), F.col(s(text_col)).alias("__text"))
    schema = f"{ddl(rows.drop('__text'))}, n_words long, n_features long, buckets binary"
    scan = _bucketed(n, buckets)
    made = materialise(rows.mapInArrow(scan, schema), "buckets")
    wanted = target.select(F.col(f"`{target_col}`").alias("__text")).mapInArrow(scan, "n_words long, n_features long, buckets binary")
    sent = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets)))
    weighed = made.mapInArrow(_weigher(sent, buckets), schema.replace("buckets binary", "weight long"))
    scored = materialise(weighed.withColumn("score", F.col("weight") + gumbel(seed, key)), "scored")
    able = F.col("n_words") >= least_words
    take = scored.filter(able).count() * percent // 100
    drawn = ranked(scored.filter(able), parts_for(scored), F.col("score").desc(), key.asc_nulls_last(), F.col("__at").asc())
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    out = drawn.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return s.back(out, *ADDED, without=text_col)


ADDED = ("n_words", "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir):
    """All documents weighed towards the benchmark by single words, and a tenth of those with 20 words or more drawn; see resample()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: A text's CRC-32 in SQL: the 256 steps of a byte as a list, and a fold over the bytes.
CRC_STEPS = "SELECT list(r ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS r FROM range(256) s(i))"
CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({w}))),
  lambda i: ((strpos('0123456789ABCDEF', substr(hex(encode({w})), (2 * i + 1)::BIGINT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({w})), (2 * i + 2)::BIGINT, 1)) - 1)::BIGINT)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH crc AS ({CRC_STEPS}),
dw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
known AS (SELECT w, {CRC_OF.format(w="w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), crc),
d AS (SELECT doc_id, bucket FROM dw JOIN known USING (w)),
sc AS (SELECT bucket, count(*) AS s FROM d GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM bw JOIN known USING (w) GROUP BY bucket),
g AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT bucket FROM known) b LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM d JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(total // n_features - (total % n_features < 0)::BIGINT, 0) AS weight,
             ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""
