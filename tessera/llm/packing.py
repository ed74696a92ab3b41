"""Lexical retrieval packing: sequences of one window, each filled with what BM25 finds nearest to its seed."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder
from tessera.llm.common import bound_batches, give_back, lean, materialise, slices, table, text_buffers, worker_cache

VOCABULARY, WINDOW, END = "byte_bpe_50k.json", 2048, 1
#: Documents of one shard of the index, query terms of a seed, and neighbours that are tried whole before one is cut.
SHARD_ROWS, QUERY_TERMS, WHOLE = 2048, 24, 32
K1, B = 1.2, 0.75


@lean
def _pieces(vocabulary: str, window: int, end: int, shards: int, with_ids: bool):
    def run(batches):
        encoder, seen = Encoder.get(vocabulary), {}
        for b in batches:
            data, offs, _ = text_buffers(b.column(1))
            tags = b.column(2).to_pylist()
            for i, j in slices(offs, 1 << 19):
                texts = [bytes(data[offs[k] : offs[k + 1]]).decode() for k in range(i, j)]
                ids, at = encoder.encode(texts)
                out: list[list] = [[] for _ in range(8)]
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], end).astype("<u4")
                    tag = tags[i + k]
                    again = seen[tag] = seen.get(tag, -1) + 1  # rows that repeat are dealt to shards in turn
                    shard = (tag + again) % shards
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        full = len(piece) == window
                        raw = None if full and not with_ids else piece.astype("<u2").tobytes() if end < 65536 and encoder.small else piece.tobytes()
                        for c, v in zip(out, (i + k, shard, s, len(piece), zlib.crc32(piece.tobytes()) if full else 0, len(own), raw, again), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int32()), b.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(c, pa.int64()) for c in out[2:6]], pa.array(out[6], pa.binary()), pa.array(out[7], pa.int64())], ["shard", "id", "start", "length", "crc", "doc_tokens", "ids", "again"])

    return run


def _ids(batch, k: int, small: bool) -> np.ndarray:
    return np.frombuffer(batch.column("ids")[k].as_buffer(), "<u2" if small else "<u4").astype(np.int64)


@lean
def _document_counts(window: int, small: bool):
    """Terms and in how many remainders they are, once a task."""

    def run(batches):
        worker_cache().clear()  # the encoder's tables, which are large
        pa.default_memory_pool().release_unused()
        counts = np.zeros(0, np.int64)
        for b in batches:
            for k in np.flatnonzero(b.column("length").to_numpy() < window).tolist():
                own = np.unique(_ids(b, k, small))
                if own[-1] >= len(counts):
                    counts = np.append(counts, np.zeros(own[-1] + 1 - len(counts), np.int64))
                counts[own] += 1
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[terms])], ["term", "n"])

    return run


def leading_term(ids: np.ndarray, df: np.ndarray, n: int, mean: float) -> int:
    """The heaviest term by BM25 over the whole corpus that another document has too, or -1."""
    terms, tf = np.unique(ids, return_counts=True)
    own = df[terms]
    weight = np.log1p((n - own + 0.5) / (own + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
    weight[own < 2] = -1.0
    best = int(np.argmax(weight))
    return int(terms[best]) if weight[best] >= 0 else -1


@lean
def _leading(window: int, small: bool, df: np.ndarray, n: int, mean: float):
    """Puts the leading term of each remainder, from 1 (0: none), in place of its shard; full windows keep theirs, below 0."""

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            lead = [-1 - s if full else leading_term(_ids(b, k, small), df, n, mean) + 1 for k, (s, full) in enumerate(zip(b.column("shard").to_pylist(), length == window, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(lead, pa.int32()), *b.columns[1:]], b.schema.names)

    return run


def by_content(pieces: DataFrame, window: int, small: bool) -> DataFrame:
    """Deals the remainders of pieces to shards of about SHARD_ROWS by their leading terms: those of one term lie side by side, in random
    order where they fill many shards. What is collected has a row a term of the vocabulary at most."""
    pieces = materialise(pieces, "pieces")
    rest = pieces.filter(F.col("length") < window)
    n, tokens = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
    if n <= SHARD_ROWS:
        return pieces.withColumn("shard", F.when(F.col("length") < window, F.lit(0)).otherwise(F.col("shard")).cast("int"))
    found = rest.mapInArrow(_document_counts(window, small), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(max(r["term"] for r in found) + 1, np.int64)
    for r in found:
        df[r["term"]] = r["n"]
    schema = ", ".join(f"{c} {k}" for c, k in pieces.dtypes)
    led = materialise(pieces.mapInArrow(_leading(window, small, df, n, tokens / n), schema), "led")
    sizes, start, at = led.filter("shard >= 0").groupBy("shard").count().orderBy("shard").collect(), 0, []
    for r in sizes:
        at.append((r["shard"], start, r["count"]))
        start += r["count"]
    dealt = led.join(F.broadcast(led.sparkSession.createDataFrame(at, "__lead int, __start long, __size long")), F.col("shard") == F.col("__lead"), "left")
    place = ((F.col("__start") + F.pmod(F.xxhash64("id", "ids", "again"), F.col("__size"))) / SHARD_ROWS).cast("int")
    return dealt.select(F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(place).cast("int").alias("shard"), *[c for c in led.columns if c != "shard"])


class Index:
    """A BM25 inverted index of a shard's remainders; terms are token ids."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        self.n, lens = n, np.array([len(d) for d in docs], np.float64)
        key = np.repeat(np.arange(n, dtype=np.int64), lens.astype(np.int64)) << 32 | np.concatenate(docs).astype(np.int64)
        key, tf = np.unique(key, return_counts=True)
        self.doc, self.term = (key >> 32).astype(np.int64), key & 0xFFFFFFFF
        self.by_doc = np.searchsorted(self.doc, np.arange(n + 1))
        order = np.argsort(self.term, kind="stable")
        terms, first = np.unique(self.term[order], return_index=True)
        self.first = np.append(first, len(order))
        df = np.diff(self.first)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.entry = np.searchsorted(terms, self.term)  # each entry's term as an index of terms
        weight = idf[self.entry] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[self.doc] / lens.mean()))
        self.post_doc, self.post_weight, self.df = self.doc[order], weight[order], df
        self.weight = weight

    def scores(self, d: int) -> np.ndarray:
        """Of all documents for the heaviest terms of d that others have too."""
        a, e = self.by_doc[d], self.by_doc[d + 1]
        t, w = self.entry[a:e], self.weight[a:e]
        shared = self.df[t] > 1
        t, w = t[shared], w[shared]
        if len(t) > QUERY_TERMS:
            t = t[np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS]]
        if not len(t):
            return np.zeros(self.n)
        lo, n = self.first[t], self.df[t]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.post_doc[at], self.post_weight[at], self.n)


def fill_windows(docs: list[np.ndarray], window: int):
    """Sequences as lists of (document, start in it, length); every token is in one piece, and all but the last are full.

    The longest unused document is the seed. Its best unused neighbours that fit are taken whole; the best that is left is cut to the
    room that is left, and its rest stays unused. Where no unused document shares a term with the seed, the longest goes in.
    """
    index = Index(docs)
    left, start = np.array([len(d) for d in docs]), np.zeros(len(docs), np.int64)
    order, head = np.argsort(-left, kind="stable"), 0
    while True:
        while head < len(order) and not left[order[head]]:
            head += 1
        if head == len(order):
            return
        seed = int(order[head])
        out, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        if room:
            score = index.scores(seed)
            score[left == 0] = 0
            near = np.flatnonzero(score)
            near = near[np.argsort(-score[near], kind="stable")]
            for d in near[:WHOLE].tolist():
                if left[d] <= room:
                    out.append((d, int(start[d]), int(left[d])))
                    room -= int(left[d])
                    left[d] = 0
                    if not room:
                        break
        rest = iter(near.tolist()) if room else iter(())
        while room:
            d = next((d for d in rest if left[d]), None)
            if d is None:
                while head < len(order) and not left[order[head]]:
                    head += 1
                if head == len(order):
                    break
                d = int(order[head])
            n = min(room, int(left[d]))
            out.append((d, int(start[d]), n))
            start[d] += n
            left[d] -= n
            room -= n
        yield out


def _fill(window: int, small: bool, with_ids: bool):
    def run(t: pa.Table) -> pa.Table:
        worker_cache().clear()  # the encoder's tables, where by_content() has not run
        give_back()
        t = t.combine_chunks().sort_by([("id", "ascending"), ("start", "ascending"), ("crc", "ascending"), ("ids", "ascending")])
        shard, ids, doc, start, tokens = t.column("shard")[0].as_py(), t.column("ids"), t.column("id"), t.column("start").to_numpy(), t.column("doc_tokens").to_numpy()
        length, crc = t.column("length").to_numpy(), t.column("crc").to_numpy()
        full = length == window
        out: list[list] = [[] for _ in range(6)]
        raw: list = []

        def add(k, s, n, c, seq, off, x):
            for col, v in zip(out, (k, s, n, c, shard << 32 | seq, off), strict=True):
                col.append(v)
            raw.append(x)

        seq = 0
        for k in np.flatnonzero(full).tolist():
            add(k, int(start[k]), window, int(crc[k]), seq, 0, np.frombuffer(ids[k].as_buffer(), "<u2" if small else "<u4").astype("<u4").tobytes() if with_ids else None)
            seq += 1
        rows = np.flatnonzero(~full)
        if len(rows):
            docs = [np.frombuffer(ids[k].as_buffer(), "<u2" if small else "<u4") for k in rows.tolist()]
            for pieces in fill_windows(docs, window):
                off = 0
                for d, s, n in pieces:
                    x, k = docs[d][s : s + n].astype("<u4").tobytes(), int(rows[d])
                    add(k, int(start[k]) + s, n, zlib.crc32(x), seq, off, x if with_ids else None)
                    off += n
                seq += 1
        at = pa.array(out[0], pa.int64())
        cols = [doc.take(at), *[pa.array(c, pa.int64()) for c in out[1:4]], pa.array(tokens).take(at), *[pa.array(c, pa.int64()) for c in out[4:]]]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([*cols, *([pa.array(raw, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most window tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and
    with_ids: ids, little-endian unsigned 32-bit).

    A document is its ids and one end id. Every full window of a long document is a sequence of its own; what is left of each document,
    shorter than a window, goes to a shard of the index with about SHARD_ROWS documents, and fill_windows() packs each shard: one
    sequence a shard has padding. Remainders with the same leading term, see leading_term(), lie in the same shard or in those beside
    it; a term that fills many shards is dealt at random over them, so no key, text or null can make a shard large. Texts are encoded
    once; ids of full windows are not shuffled (unless asked for).

    Shards are dealt by id and text, so the result doesn't depend on how the table is split, but for which of equal rows goes where.

    A null text is empty and has the end id alone. Rows that repeat are packed each for itself; a null id stays null. An empty table
    gives an empty result. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = d.withColumn("tag", F.xxhash64("id", "text"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    small = Encoder.is_small(vocabulary) and end < 65536
    kind = dict(d.dtypes)["id"]
    pieces = d.mapInArrow(_pieces(vocabulary, window, end, shards, with_ids), f"shard int, id {kind}, start long, length long, crc long, doc_tokens long, ids binary, again long")
    pieces = by_content(pieces, window, small) if shards > 1 else pieces
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return pieces.groupBy("shard").applyInArrow(_fill(window, small, with_ids), schema).withColumnRenamed("id", id_col)


def op9_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
