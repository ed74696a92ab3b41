"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, lean, mix, slices, table, text_buffers, with_columns, worker_cache

#: Hash buckets of an n-gram, lengths of n-grams, additive smoothing.
BUCKETS, ORDERS, ALPHA = 1 << 16, (1, 2, 3), 0.5
#: Labelled documents of each language that the classifier is fitted on, about: a sample by hash of the id.
SAMPLE_ROWS = 4000
#: Languages at most, which bounds the model that is broadcast to 256 MB; more are refused.
MOST_LANGS = 1000
#: Bytes of text that are worked on at a time: a code point has several 8-byte numbers and a probability for each language.
_TASKS, _SLICE = 8, 1 << 18


class Model(NamedTuple):
    """Sent to workers as a plain tuple, for they may not have this package."""

    langs: list[str]
    weight: np.ndarray  # log-probabilities, buckets by languages
    prior: np.ndarray


def _codes() -> np.ndarray:
    """Each code point's lower case; 32 for what is no letter."""
    cache = worker_cache()
    if "letters" not in cache:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        cache["letters"] = out
    return cache["letters"]


def _segments(data: np.ndarray, offs: np.ndarray):
    """Runs of whole texts of _SLICE bytes at most, and stretches of longer texts: texts [i, j), bytes [a, e), and how many characters at
    the start belong to the stretch before, whose n-grams go over the border."""
    for i, j in slices(offs, _SLICE):
        a, end = int(offs[i]), int(offs[j])
        if j - i > 1 or end - a <= _SLICE:
            yield i, j, a, end, 0
            continue
        over = 0
        while a < end:
            e = min(end, a + _SLICE)
            while e < end and data[e] & 0xC0 == 0x80:
                e -= 1
            yield i, j, a, e, over
            if e == end:
                break
            a = e
            for over in range(1, max(ORDERS)):  # so many characters back
                a -= 1
                while data[a] & 0xC0 == 0x80:
                    a -= 1


def _grams(text: bytes, offs: np.ndarray, over: int = 0):
    """Codes, each text's first code (one more than texts), and for each order the buckets and which n-grams count: those that lie in one
    text and end after the first `over` characters."""
    raw = np.frombuffer(text, np.uint8)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offs]
    codes = _codes()[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)].astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    grams, h = [], codes
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h.copy()
            h[n - 1 :] = h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + codes[: len(codes) - n + 1]
        if n in ORDERS:
            grams.append(((mix(h + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int64), place >= max(n - 1, over)))
    return codes, at, grams


@lean
def _count(langs: list[str]):
    """Rows of (language, its counts by bucket as bytes), one for each language that the task has seen."""

    def run(batches):
        counts, rank = {}, {x: k for k, x in enumerate(langs)}
        for b in batches:
            data, offs, _ = text_buffers(b.column(1))
            lang = np.array([rank[x] for x in b.column(0).to_pylist()], np.int64)
            for i, j, a, e, over in _segments(data, offs):
                _, at, grams = _grams(data[a:e].tobytes(), np.clip(offs[i : j + 1], a, e) - a, over)
                who = np.repeat(lang[i:j], np.diff(at))
                for k in np.unique(lang[i:j]).tolist():
                    if k not in counts:
                        counts[k] = np.zeros(BUCKETS, np.int64)
                    for bucket, ok in grams:
                        counts[k] += np.bincount(bucket[ok & (who == k)], minlength=BUCKETS)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    """One row a language."""
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
    return pa.table({"lang": t.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fits the classifier on about `rows` labelled documents of each language, chosen by a hash of id and text (all, if there are fewer; rows
    that repeat are all in or all out).

    Rows with a null text or language are not used. The sample is bounded, and so is what reaches the driver: a row of BUCKETS counts a
    language, half a megabyte each.
    """
    bound_batches(docs.sparkSession)
    seen = docs.filter(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    share = {r[0]: r[1] for r in seen.groupBy(F.col(f"`{lang_col}`").cast("string")).count().limit(MOST_LANGS + 1).collect()}
    langs = sorted(share)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    limit = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(rows / share[k]))])
    lang = F.col(f"`{lang_col}`").cast("string")
    # by the text too, so that rows without an id, or of one id, are sampled like others
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), 11) * F.lit(2.0**-53)
    sample = seen.filter(unit < F.element_at(limit, lang)).select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).repartition(_TASKS)
    made = sample.mapInArrow(_count(langs), "lang int, counts binary").groupBy("lang").applyInArrow(_summed, "lang int, counts binary")
    counts = np.zeros((len(langs), BUCKETS), np.int64)
    for r in made.collect():
        counts[r["lang"]] = np.frombuffer(r["counts"], np.int64)
    weight = np.log(counts + ALPHA) - np.log(counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)
    n = np.array([share[k] for k in langs], float)
    return Model(langs, np.ascontiguousarray(weight.T.astype(np.float32)), np.log(n / n.sum()))


def score_texts(arr, model: Model) -> tuple[list[str], np.ndarray]:
    """The best language of each text and its posterior probability; `und` and 0 for a text that is null or has no letter."""
    langs, weight, prior = model
    data, offs, _ = text_buffers(arr)
    total, letters = np.tile(prior, (len(arr), 1)), np.zeros(len(arr), np.int64)
    if not len(arr) or not langs:
        return ["und"] * len(arr), np.zeros(len(arr))
    for i, j, a, e, over in _segments(data, offs):
        if a == e:
            continue
        codes, at, grams = _grams(data[a:e].tobytes(), np.clip(offs[i : j + 1], a, e) - a, over)
        some = np.flatnonzero(np.diff(at))
        for bucket, ok in grams:
            w = weight[bucket]
            w[~ok] = 0
            total[i + some] += np.add.reduceat(w, at[:-1][some], axis=0, dtype=np.float64)
        letters[i + some] += np.add.reduceat(codes != 32, at[:-1][some], dtype=np.int64)
    top = total.argmax(axis=1)
    p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    p[letters == 0] = 0
    return [langs[k] if n else "und" for k, n in zip(top.tolist(), letters.tolist(), strict=True)], p


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to each row, from the whole text alone; the model is broadcast (languages by BUCKETS floats).

    A null text, an empty one and one without a letter is `und` with score 0. An empty table gives an empty result. Input columns
    named lang_pred or score, in any case, are replaced. keep: the columns that go along, all by default.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    named = {c: f"c{k}" for k, c in enumerate(keep)}
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    schema = d.select("*").schema.add("lang_pred", "string").add("score", "double")  # add() changes what it is called on
    if text_col in keep and dict(d.dtypes)[named[text_col]] == "string":  # it goes along: once is enough
        at = keep.index(text_col)
    else:
        at, d = len(keep), docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.col(f"`{text_col}`").cast("string").alias("__text"))

    @lean
    def scored():
        def run(batches):
            for b in batches:
                best, prob = score_texts(b.column(at), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(best, pa.string()), pa.array(prob, pa.float64())], [*named.values(), "lang_pred", "score"])

        return run

    out = d.mapInArrow(scored(), schema)
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], "lang_pred", "score")


def fold(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op10_langid(spark, sf_dir):
    """Languages of all documents, learned from those whose crc32 of the id is not 0 modulo 5."""
    d = table(spark, sf_dir, "documents")
    model = fit(d.filter(F.coalesce(fold("doc_id", 5), F.lit(-1)) != 0))
    out = predict(d, model, keep=["doc_id"])
    return with_columns(out, {"held_out": F.coalesce(fold("doc_id", 5) == 0, F.lit(False))}).select("doc_id", "held_out", "lang_pred", "score")
