"""Order MinHash: document fingerprints whose likeness follows the edit distance, for they know the order of what they select."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Shelter, ddl, materialise, mix, parts_for, table

#: Code points of a k-mer, k-mers that an element of the signature selects, and elements.
K, SELECTED, ELEMENTS = 8, 2, 64
#: K-mers that are ranked at a time; a longer text is worked through in such stretches.
STRETCH = 1 << 11
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PERMUTE = mix(np.arange(1, 2 * ELEMENTS + 1, dtype=np.uint64) * _MUL)
_XOR, _ODD = _PERMUTE[:ELEMENTS, None], _PERMUTE[ELEMENTS:, None] | np.uint64(1)
_LAST = np.uint64(2**64 - 1)


def kmers(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of K code points; of a shorter text, one of the whole; of an empty text none."""
    n, k = len(codes), min(K, len(codes))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = (out + codes[i : n - k + 1 + i]) * _MUL
        out ^= out >> np.uint64(29)
    return mix(out)


def numbered(h: np.ndarray) -> np.ndarray:
    """The hash of each k-mer with its occurrence number, 0 for its first place in the text. K-mers are told apart by the bits of their hash
    that a place leaves free (44 of a text of a million)."""
    n = len(h)
    if n < 2:
        return mix(h)
    bits = np.uint64(n.bit_length())
    places = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    at = (places & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    run = places >> bits
    first = np.empty(n, bool)
    first[0], first[1:] = True, run[1:] != run[:-1]
    heads = np.flatnonzero(first)
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = np.arange(n) - np.repeat(heads, np.diff(heads, append=n))
    return mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93))


def least(x: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Under each of the ELEMENTS permutations the SELECTED smallest of x, and their places (from start on); fewer if x is shorter."""
    found = None
    rows = np.arange(ELEMENTS)
    for i in range(0, len(x), STRETCH):
        ranks = (x[None, i : i + STRETCH] ^ _XOR) * _ODD
        values, places = [], []
        for _ in range(min(SELECTED, ranks.shape[1])):
            at = ranks.argmin(axis=1)
            values.append(ranks[rows, at])
            places.append(at + (start + i))
            ranks[rows, at] = _LAST
        now = np.stack(values, axis=1), np.stack(places, axis=1)
        found = now if found is None else smaller(found, now)
    return found or (np.zeros((ELEMENTS, 0), np.uint64), np.zeros((ELEMENTS, 0), np.int64))


def smaller(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The SELECTED smallest of two choices; of equal ranks the earlier place, for a's places are before b's."""
    values, places = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    take = np.argsort(values, axis=1, kind="stable")[:, :SELECTED]
    return np.take_along_axis(values, take, axis=1), np.take_along_axis(places, take, axis=1)


def signature(h: np.ndarray, chosen: tuple) -> np.ndarray:
    """Of each element, a 16-bit hash of its k-mers (without their numbers) in the order of the text."""
    places = np.sort(chosen[1], axis=1)
    out = np.full(ELEMENTS, np.uint64(places.shape[1]))
    for c in range(places.shape[1]):
        out = mix((out + h[places[:, c]]) * _MUL)
    return (out >> np.uint64(48)).astype(np.uint16)


def fingerprint(text: str) -> str:
    """The fingerprint of one text, in hex: ELEMENTS hashes of 16 bits. Of an empty text, hashes of nothing."""
    h = kmers(_codes(text))
    return signature(h, least(numbered(h))).astype(">u2").tobytes().hex()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Doc:
    """One text with its signature. What the text shares with its edited form, the k-mers of the part that stays, is ranked once."""

    def __init__(self, text: str):
        self.codes = _codes(text)
        self.h = kmers(self.codes)
        self.stays = len(self.codes) - len(self.codes) // 2
        self.shared = max(0, self.stays - K + 1) if len(self.codes) >= K else 0
        x = numbered(self.h)
        self.first = least(x[: self.shared])
        self.own = signature(self.h, smaller(self.first, least(x[self.shared :], self.shared)))

    def edited(self, other: "_Doc") -> tuple[bytes, np.ndarray]:
        """SHA-256 and signature of the edited text."""
        codes = np.concatenate([self.codes[: self.stays], other.codes[: len(self.codes) // 2]])
        h = kmers(codes)
        shared = self.shared if len(codes) >= K else 0
        x = numbered(h)
        chosen = smaller(self.first if shared else least(x[:0]), least(x[shared:], shared))
        return hashlib.sha256(codes.tobytes().decode("utf-32-le").encode()).digest(), signature(h, chosen)


#: What a task writes: a row as digests, and the text of its first and of its last row, whose neighbours are in other tasks.
_DIGESTS = "n_chars long, fingerprint binary, edited binary, edited_fingerprint binary, near_edited double, near_next double, head string, tail string"
_TYPES = pa.schema([("n_chars", pa.int64()), ("fingerprint", pa.binary()), ("edited", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("head", pa.string()), ("tail", pa.string())])


def _like(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / ELEMENTS


def _digests(one: _Doc, after: _Doc) -> list:
    sha, sig = one.edited(after)
    return [len(one.codes), one.own.astype(">u2").tobytes(), sha, sig.astype(">u2").tobytes(), _like(one.own, sig), _like(one.own, after.own)]


def _batch(others: list[pa.Table], rows: list[list]) -> pa.RecordBatch:
    left = pa.concat_tables(others).combine_chunks()
    right = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.Table.from_arrays([*left.columns, *right], schema=pa.schema([*left.schema, *_TYPES])).combine_chunks().to_batches()[0]


def _fingerprints(batches):
    """Over rows in order, the text last: each is done when the row after it is read, which may be of the next batch; a task's last row isn't."""
    held = None  # the last row read: its other columns, text, _Doc, and the text again if it is the task's first
    for b in batches:
        t = pa.Table.from_batches([b])
        others, texts, rows = t.drop_columns(t.column_names[-1:]), b.column(b.num_columns - 1), []
        before = [held[0]] if held else []
        for i in range(len(texts)):
            text = texts[i].as_py()
            now = _Doc(text)
            if held:
                rows.append([*_digests(held[2], now), held[3], None])
            held = (others.slice(i, 1), text, now, None if held else text)
        if rows:
            yield _batch([*before, others.slice(0, len(texts) - 1)], rows)
    if held:
        yield _batch([held[0]], [[len(held[2].codes), held[2].own.astype(">u2").tobytes(), None, None, None, None, held[3], held[1]]])


def _finish(batches):
    """Rows that were the last of their task, with their text and the next task's first."""
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            rows = [[*_digests(_Doc(tail), _Doc(head)), None, None] for head, tail in zip(t["head"].to_pylist(), t["tail"].to_pylist(), strict=True)]
            yield _batch([t.drop_columns(_TYPES.names)], rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited and near_next in place of each row's text.

    Order MinHash: a text's k-mers, each with its occurrence number, are ranked under ELEMENTS permutations; of each the SELECTED smallest,
    in the order of the text, are hashed together. The likeness of two fingerprints is their share of equal hashes. The edited text is the
    row's own with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's, by descending id; after
    the last row comes the first.

    Rows are dealt once, by ranges of (id, hash of the text, place in the input), so that rows that share an id are spread too, and each
    task goes through its sorted rows with one row in hand. Only its first and its last text meet those of other tasks, in a join of two
    rows a task. Memory is that of a batch and about 60 bytes for a code point of the longest text.

    A null text counts as empty: no k-mers, a fingerprint of nothing, which is 1.0 like that of another empty text. A text shorter than K
    is one k-mer. Null ids come last, of rows with one id those of the larger hash first; rows that agree in id and text are in any order.
    A table of one row is its own next. An empty table gives an empty result. Input columns named as added ones, in any case, are replaced.
    """
    s = Shelter(docs)
    text = F.coalesce(F.col(s(text_col)), F.lit(""))
    others = [c for c in s.df.columns if c != s(text_col)]
    rows = s.df.select(*others, text.alias("__text"), F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__at"))
    order = [F.col(s(id_col)).desc_nulls_last(), F.col("__h").desc(), F.col("__at")]
    dealt = rows.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order).select(*others, "__text")
    schema = f"{ddl(dealt.select(*others))}, {_DIGESTS}"
    made = materialise(dealt.mapInArrow(_fingerprints, schema).withColumn("__part", F.spark_partition_id()), "prints")
    # a task gives a head and a tail: the window runs over the number of tasks
    ends = made.filter("head IS NOT NULL OR tail IS NOT NULL").groupBy("__part").agg(F.max("head").alias("head"))
    circle = Window.orderBy("__part")
    ends = ends.select("__part", F.coalesce(F.lead("head").over(circle), F.first("head").over(circle)).alias("__head"))
    tails = made.filter("tail IS NOT NULL").join(ends, "__part").withColumn("head", F.col("__head"))
    last = tails.select(*others, *_TYPES.names).mapInArrow(_finish, schema)
    out = made.filter("tail IS NULL").drop("__part").unionByName(last)
    as_hex = {"fingerprint": F.lower(F.hex("fingerprint")), "edited_fingerprint": F.lower(F.hex("edited_fingerprint")), "edited_sha256": F.lower(F.hex("edited"))}
    return s.back(out.withColumns(as_hex), *ADDED, without=text_col)


ADDED = ("n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next")


def op11_order_minhash(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts; see fingerprints()."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *ADDED)
