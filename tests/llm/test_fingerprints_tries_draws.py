"""Order MinHash, the prefix trie and importance resampling: SQL, restatements in Python, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_plans import TABLES, canonical

from tessera.llm import order_minhash, prefix_trie, resampling
from tessera.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
LONG = "Señor ab, cd-12\n" * 70_000
ODD = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, " \t\n", None, None), (4, "one", "b", 2.0), (5, "one", "b", 2.0), (5, "one", "b", 2.0), (5, "two", "b", 2.0), (6, LONG, "a", 0.0), (None, "one", None, 0.0), (None, None, None, None), (7, "日本語 İstanbul ñandú \U0001f600 ABCDEFGHIJ", "", 3.0)]
SCHEMA = "doc_id long, text string, fingerprint string, Weight double"


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


# Order MinHash


def plain_signature(text: str) -> list:
    """Elements as tuples of k-mers, with the operator's hashes and permutations but by a plain sort."""
    k = min(order_minhash.K, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if text else []
    h = order_minhash.kmers(np.array([ord(c) for c in text], np.uint32)).tolist()
    seen, x = Counter(), []
    for a in h:
        x.append(int(order_minhash.mix(np.array([(a + seen[a] * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0]))
        seen[a] += 1
    out = []
    for xor, odd in zip(order_minhash._XOR[:, 0].tolist(), order_minhash._ODD[:, 0].tolist(), strict=True):
        best = sorted(range(len(x)), key=lambda i: ((x[i] ^ xor) * odd % 2**64, i))[: order_minhash.SELECTED]
        out.append(tuple(grams[i] for i in sorted(best)))
    return out


def test_signatures_are_those_of_a_plain_sort():
    rng = random.Random(5)
    texts = ["", "a", "abc", "abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc" * 9]
    texts += ["".join(rng.choice("abcde ñ語") for _ in range(n)) for n in (9, 50, 300, 2047, 2055, 2060, 4500)]
    texts += [texts[-1][:4000] + texts[-2], texts[-3][5:]]
    plain = [plain_signature(t) for t in texts]
    prints = [order_minhash.fingerprint(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            same = sum(x == y for x, y in zip(plain[a], plain[b], strict=True))
            got = sum(prints[a][4 * i : 4 * i + 4] == prints[b][4 * i : 4 * i + 4] for i in range(order_minhash.ELEMENTS))
            assert same == got, (texts[a][:20], texts[b][:20])


def test_likeness_falls_with_the_order_of_the_text():
    rng = random.Random(1)
    blocks = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(8)]
    like = lambda a, b: order_minhash._like(*(np.frombuffer(bytes.fromhex(order_minhash.fingerprint(t)), ">u2") for t in (a, b)))
    text = " ".join(blocks)
    swapped, turned, changed = " ".join(blocks[4:] + blocks[:4]), " ".join(blocks[::-1]), text.replace(blocks[3][:30], "x" * 30)
    # two k-mers keep their order if they are of one half, or of one block
    assert like(text, text) == 1 and like(text, changed) > 0.85 and 0.3 < like(text, swapped) < 0.7 and like(text, turned) < 0.3 and like(text, " ".join("qrstuv" for _ in range(400))) == 0


def restated(rows: list) -> list:
    """Of (id, text) rows in order, the digests."""
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, nxt = (order_minhash.fingerprint(t) for t in (text, edited, after))
        like = lambda a, b: sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(64)) / 64
        out.append((doc, len(text), own, hashlib.sha256(edited.encode()).hexdigest(), new, like(own, new), like(own, nxt)))
    return out


def test_fingerprints_over_several_tasks(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 1, 5, 9, 40, 700])))) for i in range(60)]
    got = order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id int, text string").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(restated(sorted(rows, reverse=True)))
    assert [tuple(r) for r in order_minhash.fingerprints(spark.createDataFrame(rows[:1], "doc_id int, text string")).collect()] == restated(rows[:1])


def test_fingerprints_of_odd_rows(spark):
    got = order_minhash.fingerprints(spark.createDataFrame(ODD, SCHEMA))
    assert got.columns == ["doc_id", "Weight", *order_minhash.ADDED] and got.count() == len(ODD)
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert by[1][0]["n_chars"] == 0 and by[6][0]["n_chars"] == len(LONG) and len(by[5]) == 3 and len(by[None]) == 2
    assert {r["fingerprint"] for r in by[5]} | {by[4][0]["fingerprint"]} == {order_minhash.fingerprint("one"), order_minhash.fingerprint("two")}
    assert by[2][0]["near_next"] == 1.0 and by[7][0]["near_next"] == 0.0  # 2 is followed by 1, both empty
    half = len(ODD[-1][1]) // 2
    assert by[7][0]["edited_sha256"] == hashlib.sha256((ODD[-1][1][: len(ODD[-1][1]) - half] + LONG[:half]).encode()).hexdigest()
    assert order_minhash.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


# The prefix trie


def brute_trie(convs: dict) -> list:
    """Nodes of sequences of (role, text), by plain dictionaries of prefixes."""
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            p = tuple(turns[:d])
            members[p].append(c)
            if d:
                words[p] = len(re.findall(r"[^\x20\x09-\x0D]+", turns[d - 1][1]))
        ends[tuple(turns)].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(df) -> list:
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("run_bytes", [200, 1 << 20])
def test_trie_of_random_conversations(spark, monkeypatch, run_bytes):
    """Few turns and many repeats, so that runs, ranges and paths meet in all ways; a third of the conversations are the same."""
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", run_bytes)
    rng = random.Random(3)
    turns = [("user", "a b"), ("user", "a  b c"), ("", "x"), ("use", "rx"), ("a", "")]
    convs = {c: [rng.choice(turns) for _ in range(rng.choice([0, 1, 2, 3, 6, 9]))] if c % 3 else [turns[0]] * 4 for c in range(-40, 200)}
    convs[7] = [turns[0]] * 200
    rows = [(c, pos, *t) for c, ts in convs.items() for pos, t in enumerate(ts)]
    numbered = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3))
    empty = spark.createDataFrame([(c, 0, None) for c in convs], "conv_id long, pos int, item binary")
    assert trie_rows(prefix_trie.prefix_trie(numbered.unionByName(empty))) == brute_trie(convs)


def test_trie_with_shared_heads(spark):
    """Rebuilt conversations against plain Python; null and repeated turns, null ids, missing and short first conversations."""
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["u", "v"]), rng.choice(["x", "y z"])) for c in [*range(0, 45), *range(61, 70), 80, *range(81, 85), -25] for t in range(rng.choice([1, 2, 5]))]
    rows += [(3, None, None, None), (3, None, "a", None), (None, 1, "u", "x"), (80, 0, "u", "x"), (80, 0, "u", "x")]
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))))
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            by[c].append((-1 if t is None else t, digest, (role, text)))
    turns = {c: [x[2] for x in sorted(ts)] for c, ts in by.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    assert got == brute_trie(rebuilt)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.numbered_turns(empty))).count() == 0


def test_loser_tree_never_compares_shared_turns_again(monkeypatch):
    """Ten thousand turns that all sequences share are compared once for each run, not once a match."""
    head = b"h" * (prefix_trie.TURN * 10_000)
    runs = [[((head + bytes([a]) * prefix_trie.TURN * 2), c) for c, a in enumerate(range(r, 200, 8))] for r in range(8)]
    made = [[(s, n, i) for s, n, i in prefix_trie.sorted_run(r)] for r in runs]
    looked, plain = [], prefix_trie.common
    monkeypatch.setattr(prefix_trie, "common", lambda a, b, n: looked.append(plain(a, b, n) - n) or plain(a, b, n))
    out = [(h[0], n) for h, n in prefix_trie.LoserTree([iter(r) for r in made]).pairs()]
    assert [s for s, _ in out] == sorted(s for r in runs for s, _ in r) and out[0][1] == 0 and all(n == 10_000 for _, n in out[1:])
    assert sum(looked) <= 8 * 10_000 + 200 * 4 * 2


# Importance resampling


def runs_of(text: str | None, n: int) -> list:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)], len(w)


@pytest.mark.parametrize("n", [1, 3])
def test_weights_scores_and_ranks(spark, n):
    docs = ODD + [(100 + i, f"Alpha beta{i % 7} gamma DELTA-{i % 3} " * (i % 9), "s", 0.0) for i in range(80)]
    target = [(1, "alpha beta1 gamma"), (2, None), (3, "one delta 2")]
    got = resampling.resample(spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(target, "item int, text string"), n=n, buckets=997, percent=15, least_words=9).collect()
    s, t = Counter(), Counter()
    feats = [runs_of(d[1], n) for d in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 997
    for f, _ in feats:
        s.update(map(bucket, f))
    for _, text in target:
        t.update(map(bucket, runs_of(text, n)[0]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 997) / ((s[b] + 1) * (t.total() + 997)))) for b in range(997)]
    want = []
    for (doc, *_), (f, words) in zip(docs, feats, strict=True):
        w = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        want.append((doc, words, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    able = sorted((-r[4], r[0]) for r in want if r[1] >= 9)
    drawn = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert drawn == [(i + 1, d) for i, (_, d) in enumerate(able[: len(able) * 15 // 100])] and drawn


def test_resampling_of_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).count() == 0
    rows = resampling.resample(spark.createDataFrame(ODD, SCHEMA), target, least_words=0, percent=100)
    assert rows.columns == ["doc_id", "fingerprint", *resampling.ADDED]
    assert sorted(r["rank"] for r in rows.collect()) == list(range(1, len(ODD) + 1))


def test_a_word_over_a_slice_is_whole(monkeypatch):
    text = "Ab1-ñé语 x" * 50
    whole = list(resampling.words(text.encode()))
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(resampling, "SLICE_BYTES", size)
        assert list(resampling.words(text.encode())) == whole == [w.encode() for w in re.findall(r"[a-z0-9ñé语]+", text.lower())]
