"""A hidden Markov language model over words: Baum-Welch on all training texts, exact likelihoods by the scaled forward recursion."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tessera.llm.common import materialise, table, text_words, with_columns

#: Hidden states, frequent words that are symbols of their own (at most), hash buckets that stand for all other words.
STATES, HEAD, BUCKETS = 8, 61_439, 4_096
#: Passes of Baum-Welch over all training texts.
PASSES = 6
#: Tokens that a worker holds forward probabilities of at a time; count tables that one task adds up; symbols of one such table.
BLOCK_TOKENS, FAN_IN, BLOCK_SYMBOLS = 1 << 19, 64, 1_024


class Vocabulary(NamedTuple):
    """Sent to workers as a plain tuple, for they may not have this package; so is Hmm."""

    hashes: np.ndarray  # of the frequent words, ascending
    counts: np.ndarray
    bucket_tokens: np.ndarray  # training tokens of all other words, by bucket
    bucket_words: np.ndarray
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int

    @property
    def end(self) -> int:
        return len(self.hashes)

    @property
    def symbols(self) -> int:
        return len(self.hashes) + 1 + BUCKETS

    def unigram(self) -> np.ndarray:
        n = np.concatenate([self.counts + 0.5, [self.ends + 0.5], self.bucket_tokens + 1.0])
        return n / n.sum()


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(52)).astype(np.int64)


def _count_words(batches):
    def merge(parts):
        h = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        u, back = np.unique(h, return_inverse=True)
        return u, np.bincount(back, n, len(u)).astype(np.int64)

    parts, size = [], 0
    for b in batches:
        for _, _, h, _ in text_words(b.column(0)):
            parts.append(np.unique(h, return_counts=True))
            size += len(parts[-1][0])
            if size > 1 << 20:
                parts = [merge(parts)]
                size = len(parts[0][0])
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "c"])
                    parts, size = [], 0
    if parts:
        u, n = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "c"])


def vocabulary(counts: DataFrame, texts: int) -> tuple[Vocabulary, DataFrame]:
    """The model's symbols, and the counts of all other words (which stay distributed). counts: h, c. Collects HEAD + BUCKETS rows at most."""
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True)
    least, n = None, 0
    for row in sizes:
        if n + row["count"] > HEAD:
            break
        least, n = row["l"], n + row["count"]
    frequent = counts.filter(level >= least) if least is not None else counts.filter(F.lit(False))
    rest = counts.filter(level < least) if least is not None else counts
    head = frequent.toArrow()
    h, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(h)
    tokens, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in rest.groupBy(F.shiftrightunsigned("h", 52).alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["b"]], words[r["b"]] = r["n"], r["v"]
    total = int(c.sum()) + int(tokens.sum()) + texts
    return Vocabulary(h[order], c[order], tokens, words, total, len(h) + int(words.sum()) + (texts > 0), texts), rest


def _encode(sent):
    def run(batches):
        v = Vocabulary(*sent.value)
        n_head, last = len(v.hashes), max(len(v.hashes) - 1, 0)
        log_head = np.log10(v.counts + 1.0)
        log_bucket = np.log10(v.bucket_tokens + v.bucket_words + 1.0)
        pid, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, h, doc in text_words(b.column(2)):
                texts = j - i
                at = np.minimum(np.searchsorted(v.hashes, h), last)
                known = v.hashes[at] == h if n_head else np.zeros(len(h), bool)
                sym = np.where(known, at, n_head + 1 + _bucket(h))
                n = np.bincount(doc, minlength=texts)
                first = np.cumsum(n) - n
                full = np.empty(len(h) + texts, np.uint16)
                place = np.arange(len(h)) + doc
                full[place] = sym
                full[first + n + np.arange(texts)] = v.end
                cut = np.append(first + np.arange(texts), len(full))
                base = np.bincount(doc[known], log_head[at[known]], texts) if n_head else np.zeros(texts)
                inside = np.bincount(doc[~known], log_bucket[_bucket(h[~known])], texts)
                rare = pa.table({"d": doc[~known], "h": h[~known].view(np.int64)}).group_by(["d", "h"]).aggregate([([], "count_all")]).sort_by("d")
                ends = np.concatenate([[0], np.cumsum(np.bincount(rare.column("d").to_numpy(), minlength=texts))]).astype(np.int32)
                flat = lambda c, kind: pa.ListArray.from_arrays(pa.array(ends), rare.column(c).combine_chunks().cast(kind))
                key = (pid << 40) + row + np.arange(texts)
                row += texts
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).slice(i, texts), b.column(1).slice(i, texts), pa.array(n + 1), pa.array(np.bincount(doc[known], minlength=texts)), pa.array(base.astype(float)), pa.array(inside.astype(float)), pa.array([full[a:e].tobytes() for a, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), flat("h", pa.int64()), flat("count_all", pa.int32())], ["key", "id", "train", "n_tokens", "n_head", "base", "inside", "symbols", "rare", "times"])

    return run


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols by states


def _blocks(texts: list[np.ndarray]):
    """Runs of texts, longest first, of BLOCK_TOKENS at most (or one text)."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    run, size = [], 0
    for k in order:
        if run and size + len(texts[k]) > BLOCK_TOKENS:
            yield run
            run, size = [], 0
        run.append(k)
        size += len(texts[k])
    if run:
        yield run


def _by_time(texts: list[np.ndarray]):
    """Texts, longest first, as one array by time and then text; and where each time's tokens start."""
    lens = np.array([len(t) for t in texts])
    active = len(texts) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
    at = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(at[-1], np.int64)
    for k, t in enumerate(texts):
        flat[at[: len(t)] + k] = t
    return flat, at, lens


def forward(model: Hmm, texts: list[np.ndarray], keep: bool = False):
    """Natural log-likelihoods of texts (longest first); with keep, also what backward() needs. Each step is scaled to sum to 1."""
    flat, at, lens = _by_time(texts)
    emit = model.emit[flat]
    alpha, scale = (np.empty_like(emit) if keep else None), np.empty(len(flat))
    for t in range(len(at) - 1):
        lo, hi = at[t], at[t + 1]
        a = (a[: hi - lo] @ model.move if t else model.start) * emit[lo:hi]
        c = a.sum(axis=1)
        a = a / c[:, None]
        scale[lo:hi] = c
        if keep:
            alpha[lo:hi] = a
    log = np.log(scale)
    place = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    like = np.bincount(place, log, len(texts))
    return like, (flat, at, lens, emit, alpha, scale)


def expected(model: Hmm, texts: list[np.ndarray], symbols: int):
    """Expected counts of starts, moves and emissions over texts (longest first), and their log-likelihood."""
    like, (flat, at, lens, emit, alpha, scale) = forward(model, texts, keep=True)
    k = alpha.shape[1]
    move = np.zeros((k, k))
    b = np.ones((0, k))
    for t in range(len(at) - 2, -1, -1):
        lo, hi = at[t], at[t + 1]
        if t + 2 < len(at):
            lo1, hi1 = at[t + 1], at[t + 2]
            w = emit[lo1:hi1] * b / scale[lo1:hi1, None]
            move += alpha[lo : lo + hi1 - lo1].T @ w
            b = w @ model.move.T
        if len(b) < hi - lo:
            b = np.concatenate([b, np.ones((hi - lo - len(b), k))])
        alpha[lo:hi] *= b
    emits = np.stack([np.bincount(flat, alpha[:, z], symbols) for z in range(k)], axis=1)
    return alpha[: at[1]].sum(axis=0), move * model.move, emits, like.sum()


def maximise(start, move, emits, unigram) -> Hmm:
    """The model of expected counts, smoothed."""
    k = len(start)
    # Witten-Bell: a state keeps as much for the unigram as it has seen symbols
    emits = emits + np.maximum(1.0, np.minimum(emits, 1.0).sum(axis=0)) * unigram[:, None]
    return Hmm((start + 1) / (start.sum() + k), (move + 1) / (move.sum(axis=1, keepdims=True) + k), emits / emits.sum(axis=0))


def first_guess(unigram: np.ndarray, seed: int = 3) -> Hmm:
    """A seeded start with lasting states: each state has the unigram of all training texts, with every symbol at another weight."""
    rng = np.random.default_rng(seed)
    k = STATES
    emit = unigram[:, None] * rng.exponential(size=(len(unigram), k))
    return Hmm(np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), emit / emit.sum(axis=0))


def _expect(sent, symbols: int):
    def run(batches):
        model = Hmm(*sent.value)
        k = len(model.start)
        start, move, emits = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(0)]
            for run in _blocks(texts):
                s, m, e, _ = expected(model, [texts[i] for i in run], symbols)
                start, move, emits = start + s, move + m, emits + e
        parts = [np.concatenate([start[None, :], move])] + [emits[a : a + BLOCK_SYMBOLS] for a in range(0, symbols, BLOCK_SYMBOLS)]
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), pid // FAN_IN, np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "grp", "data"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("data"))
    return pa.table([t.column("part").slice(0, 1), pa.array([t.column("grp")[0].as_py() // FAN_IN], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "grp", "data"])


def train(docs: DataFrame, vocab: Vocabulary, passes: int = PASSES) -> Hmm:
    """Baum-Welch over all rows of docs (symbols) in every pass. Each task adds up its own expected counts; tables are added by FAN_IN."""
    unigram, sc = vocab.unigram(), docs.sparkSession.sparkContext
    model = first_guess(unigram)
    k = STATES
    for _ in range(passes):
        sent = sc.broadcast(tuple(model))
        sums = docs.select("symbols").mapInArrow(_expect(sent, vocab.symbols), "part int, grp long, data binary")
        groups = -(-max(1, docs.rdd.getNumPartitions()) // FAN_IN)
        while True:
            sums = sums.groupBy("part", "grp").applyInArrow(_add, "part int, grp long, data binary")
            if groups <= 1:
                break
            groups = -(-groups // FAN_IN)
        got = {r["part"]: np.frombuffer(bytes(r["data"]), np.float64).reshape(-1, k) for r in sums.collect()}
        if not got:
            break
        emits = np.concatenate([got[p] for p in range(1, len(got))])
        model = maximise(got[0][0], got[0][1:], emits, unigram)
    return model


def _score(sent):
    def run(batches):
        model = Hmm(*sent.value)
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(b.num_columns - 1)]
            like = np.zeros(len(texts))
            for run in _blocks(texts):
                like[run] = forward(model, [texts[i] for i in run])[0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(like / np.log(10))], [*b.schema.names[:-1], "like"])

    return run


def language_model(docs: DataFrame, is_training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of each text, learned from the rows where is_training holds.

    Tokens are words (A-Z lower-cased) and one end. 1. Words of all training texts are counted by 64-bit hash. 2. Words frequent enough to be
    among the HEAD first are symbols of the model; every other word is the symbol of its hash bucket, times its smoothed share of the
    bucket, (c + 1) / (tokens + words + 1), where one word stands for all unknown ones. So every text has a proper probability. 3.
    Baum-Welch runs over all training texts. 4. The scaled forward recursion gives each text's exact log10 likelihood. Frequent words
    and buckets are a bounded broadcast; the counts of all other words are joined, and a word that is not among the HEAD first has a
    bounded share of the rows. base_score: add-one unigram score.

    A null or empty text is its end alone. A null in is_training counts as false. Rows that repeat are scored each for itself. An empty
    table gives an empty result. Other columns are not read.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(is_training, F.lit(False)).alias("train"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind, sc = dict(d.dtypes)["id"], docs.sparkSession.sparkContext
    learn = d.filter("train")
    counts = materialise(learn.select("text").mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    vocab, rest = vocabulary(counts, learn.count())
    sent = sc.broadcast(tuple(vocab))
    schema = f"key long, id {kind}, train boolean, n_tokens long, n_head long, base double, inside double, symbols binary, rare array<long>, times array<int>"
    coded = materialise(d.mapInArrow(_encode(sent), schema), "coded")
    model = sc.broadcast(tuple(train(coded.filter("train").select("symbols"), vocab)))
    scored = coded.select("key", "id", "n_tokens", "n_head", "base", "inside", "symbols").mapInArrow(_score(model), f"key long, id {kind}, n_tokens long, n_head long, base double, inside double, like double")
    words = coded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("h"), F.col("w.times").alias("n"))
    found = words.join(rest.select(F.col("h").alias("__h"), "c"), F.col("h") == F.col("__h"))
    found = found.groupBy(F.col("key").alias("__key")).agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("n_rare"))
    out = scored.join(found, F.col("key") == F.col("__key"), "left")
    more = F.coalesce("more", F.lit(0.0))
    end = float(np.log10(vocab.ends + 1.0))
    total = float(np.log10(max(1.0, vocab.tokens + vocab.distinct + 1.0)))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(vocab.ends > 0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more + F.lit(end) - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("like") + more - F.col("inside")).alias("score"))


def op7_hmm(spark, sf_dir):
    """Scores of all documents, learned from those whose crc32 of the id is not 2 modulo 7."""
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(-1))
    out = language_model(table(spark, sf_dir, "documents").select("doc_id", "text"), rest != 2)
    return with_columns(out, {"held_out": rest == 2}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
