"""Sharding, mixing, exact copies, languages and packing: odd rows, and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, langid, mixing, packing, sharding
from tessera.llm.bpe import Encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, size string, shard string, steps string"
LONG = "Señor ab, cd\n" * 20_000
ODD = [
    (1, None, "en", "a", "x", "y", "z", "s"), (2, "", "en", None, None, None, None, None), (3, "  \t\n", None, "a", None, None, None, None), (4, "one", "en", "b", None, None, None, None),
    (5, "one", "en", "b", None, None, None, None), (5, "one", "en", "b", None, None, None, None), (6, LONG, "es", "a", None, None, None, None), (None, "one", None, None, None, None, None, None),
    (7, "%% 123 !!", "en", "", None, None, None, None), (8, "İstanbul ñandú 日本語", "es", "a", None, None, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, odd, empty):
    rows = sharding.interleave(odd, 3).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ODD) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.interleave(empty).count() == 0


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.concat(F.lit("s"), "id")).otherwise("b").alias("source"))
    rows = sharding.interleave(d, 16).collect()
    per = defaultdict(Counter)
    for r in rows:
        per[r["source"]][r["shard"]] += 1
    assert all(max(c.values()) - min(c[s] for s in range(16)) <= 2 for c in per.values())
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(d.repartition(7), 16).collect()}


def levels(sizes: dict, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        v = left / sum(w[s] for s in open_)
        full = {s for s in open_ if v * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: v * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_targets(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    size = {(r["doc_id"], r["text"]): r["size"] for r in rows}
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (_, t), n in size.items())
    total = Counter()
    for r in rows:
        total[r["source"]] += r["size"]
        assert 0 <= r["copies"] <= 2 and r["steps"] in ("s", None)
    want = levels(dict(total))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == total[r["source"]] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_and_reruns_agree(spark):
    rows = mixing.op6_mixing(spark, SF).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["copies"] * r["size"]) for r in mixing.mix(d).collect()}


def test_exact_copies(spark, odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r["text"] or "").encode()).hexdigest()].append(r)
    for sha, g in groups.items():
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        assert {(r["text_sha256"], r["group_size"], r["keep_id"]) for r in g} == {(sha, len(g), max(ids))}
        assert sum(r["kept"] for r in g) == 1 and all(r["doc_id"] == max(ids) for r in g if r["kept"])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_filter_in_slices(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_HASHES", 16)
    monkeypatch.setattr(exact_dedup, "SLICE_BLOCKS", 4)
    d = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 150).cast("string").alias("text"))
    rows = exact_dedup.exact_dedup(d).collect()
    assert len(rows) == 200 and sum(r["kept"] for r in rows) == 150 and all(r["group_size"] == (2 if int(r["text"]) < 50 else 1) for r in rows)


def test_languages(spark, odd, empty):
    m = langid.fit(odd)
    assert m.langs == ["en", "es"]
    rows = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.predict(odd, m).collect()}
    assert all((p == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= s <= 1 for (_, t), (p, s) in rows.items())
    none = langid.fit(empty)
    assert langid.predict(empty, none).count() == 0 and {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    got = langid.op10_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_scores_are_naive_bayes(spark):
    m = langid.fit(spark.createDataFrame([(1, "abca", "x"), (2, "bbcc", "y")], "doc_id int, text string, lang string"))
    import pyarrow as pa

    alone, _ = zip(*[(langid.score_texts(pa.array([t]), m)) for t in ("abca", "bbcc", "ab")], strict=True)
    best, prob = langid.score_texts(pa.array(["abca", "bbcc", "ab"]), m)
    assert [b for a in alone for b in a] == best and best[:2] == ["x", "y"] and all(0.5 <= p <= 1 for p in prob)


def test_encoder_matches_the_tokenizer():
    t, e, rng = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), Encoder.get(packing.VOCABULARY), np.random.default_rng(4)
    parts = ["a", "b", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "字", "!", "?!", " ", "😀", "I'm", "don't", "''s", " 's", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    ids, at = e.encode(texts)
    assert all(ids[at[k] : at[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts))


def packed(spark, d):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = packing.pack(d, with_ids=True).collect()
    want, got, seqs = Counter(), defaultdict(list), defaultdict(list)
    for r in d.collect():
        want[(r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids + [1]))] += 1
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        seqs[r["sequence_id"]].append(r)
        got[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids.tolist()))
    for s in seqs.values():
        place = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= packing.WINDOW
    return rows, want, got, seqs


def test_packing_is_a_round_trip(spark, odd, empty):
    _, want, got, _ = packed(spark, odd)
    for (doc, ids), n in want.items():
        pieces = Counter((s, tuple(x)) for s, x in got[(doc, len(ids))])
        assert sum(len(x) * c for (_, x), c in pieces.items()) >= n * len(ids)
        if n == 1 and sum(1 for (d, i) in want if d == doc and len(i) == len(ids)) == 1:
            assert [t for _, x in sorted(got[(doc, len(ids))]) for t in x] == list(ids)
    assert packing.pack(empty).count() == 0


def test_packing_wastes_little_and_joins_neighbours(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows, want, got, seqs = packed(spark, d)
    assert all([t for _, x in sorted(got[(doc, len(ids))]) for t in x] == list(ids) for doc, ids in want)
    assert sum(r["length"] for r in rows) > 0.97 * packing.WINDOW * len(seqs)
    docs = [np.array(x) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    assert [sorted(p[0] for p in s) for s in packing.fill_windows(docs, 6)] == [[0, 2], [1, 3]]
