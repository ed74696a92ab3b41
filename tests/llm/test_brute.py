"""Operators that SQL can't express, restated plainly in Python."""

import math
import os
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, hmm, langid, mixing, packing, sharding, topk, url_filter

M64 = (1 << 64) - 1


def spark_hash(*values):
    """Spark's xxhash64 of ints (a tuple ("int", x)), longs and texts; nulls are skipped."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def unit(*values):
    return (spark_hash(*values) >> 11) * 2.0**-53


def test_shards_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = [(i * 7 % 1009, "hot" if i % 3 else [None, "a", "b", "c"][i // 3 % 4]) for i in range(900)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string"), 7).collect()}
    groups, placed = defaultdict(list), []
    for i, s in rows:
        groups[s].append((unit(("int", 11), i), i))
    for s, g in groups.items():
        phase = unit(("int", 12), s)
        placed += [((k + 1 - phase) / len(g), (s is not None, s or ""), u, i) for k, (u, i) in enumerate(sorted(g))]
    want, first = {}, Counter()
    for p, (*_, i) in enumerate(sorted(placed)):
        shard = p * 7 // len(rows)
        want[i] = (shard, first[shard])
        first[shard] += 1
    assert got == want


def mixed(rows, seed=17, most=2):
    """Copies by the same draws, with the rates found by bisection."""
    sizes = defaultdict(list)
    for i, s, n in rows:
        sizes[s].append((i, n))
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for _, n in g) for s, g in sizes.items()}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * total[s]}
        target |= {s: most * total[s] for s in full} or {s: level * weight[s] for s in free}
        left -= sum(most * total[s] for s in full)
        free = free - full if full else set()
    out = {}
    for s, g in sizes.items():
        mean = max(sum(n for _, n in g) / len(g), 1e-9)
        rate = lambda lam, n: min(float(most), math.exp(min(50.0, lam * n / mean)))  # noqa: B023, E731
        lo, hi = -800.0, 800.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(rate(mid, n) * n for _, n in g) < target[s] else (lo, mid)
        out[s] = (target[s], {(i, n): rate(hi, n) for i, n in g})
    return out


def test_rates_solve_the_dual(spark, monkeypatch):
    """Rates reach the targets, and copies are within one of them after rounding and moving."""
    rng = np.random.default_rng(8)
    rows = [(i, ["a", "a", "b", "c", None][i % 5], int(rng.lognormal(3, 1.3))) for i in range(400)] + [(900, "b", 0)]
    d = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, s, n in rows], "doc_id long, source string, text string")
    want, states = mixed(rows), []
    real = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda t, name="t": states.append((t.columns, t.collect())) or real(t, name) if name == "state" else real(t, name))
    got = mixing.mix(d).collect()
    solved = [r for cols, rs in states if "near" in cols for r in rs if r["near"]]
    lam = {r["source"]: (r["lam"], r["mean"]) for r in solved}
    assert lam.keys() == want.keys()
    for s, (target, rates) in want.items():
        own = {k: min(2.0, math.exp(min(50.0, lam[s][0] * k[1] / lam[s][1]))) for k in rates}
        assert abs(sum(v * k[1] for k, v in own.items()) - target) < 0.51
        assert all(abs(own[k] - v) * k[1] < 0.6 for k, v in rates.items())  # words
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]][0]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 60 for s, (t, _) in want.items())


def grams(text):
    codes = []
    for c in text:
        low = c.lower() if c.isalpha() else " "
        codes.append(ord(low) if len(low) == 1 else ord(c))
    for n in (1, 2, 3):
        for k in range(n - 1, len(codes)):
            h = 0
            for c in codes[k - n + 1 : k + 1]:
                h = (h * 0x9E3779B97F4A7C15 + c) & M64
            h = (h + (n << 56)) & M64
            yield int(common.mix(np.array([h], np.uint64))[0]) >> 48


def test_language_posteriors(spark, monkeypatch):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the dog and the cat", "en"), ("a house", "en"), ("el perro y el gato", "es"), ("Straße über ÄÖ", "de"), ("x 1 2", None), (None, "en"), ("日本語", "ja")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts, docs = defaultdict(Counter), Counter()
    for _, t, x in rows:
        if t is not None and x is not None:
            docs[x] += 1
            counts[x].update(grams(t))
    n = {x: sum(c.values()) for x, c in counts.items()}
    texts = ["the cat", "el gato", "über", "日本", "%% 12", "", None, "ñ", "the house el über " * 400]
    for piece in (1 << 18, 64):  # long texts in stretches give the same
        monkeypatch.setattr(langid, "_SLICE", piece)
        best, prob = langid.score_texts(pa.array(texts), model)
        for t, b, p in zip(texts, best, prob, strict=True):
            if not t or not any(c.isalpha() for c in t):
                assert (b, p) == ("und", 0)
                continue
            own = Counter(grams(t))
            logs = {x: math.log(docs[x] / sum(docs.values())) + sum(k * math.log((counts[x][g] + langid.ALPHA) / (n[x] + langid.ALPHA * langid.BUCKETS)) for g, k in own.items()) for x in docs}
            top = max(logs.values())
            assert logs[b] > top - 1e-3 and abs(p - 1 / sum(math.exp(v - top) for v in logs.values())) < 1e-3


def test_scores_of_whole_texts(spark, monkeypatch):
    """Each text's score from the trained model by the plain forward sums and every rare word's share of its bucket."""
    monkeypatch.setattr(hmm, "HEAD", 5)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.6, rng.integers(0, 30)) % 50)) for i in range(60)] + [(60, None), (61, "w1 unknownword")]
    seen = {}
    real_train, real_vocabulary = hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a, **k: seen.setdefault("model", real_train(*a, **k)))
    monkeypatch.setattr(hmm, "vocabulary", lambda *a, **k: seen.setdefault("vocabulary", real_vocabulary(*a, **k)))
    got = {r.doc_id: r.score for r in hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 != 0).collect()}
    m, (v, _) = seen["model"], seen["vocabulary"]
    head = {int(h): k for k, h in enumerate(v.hashes)}
    word = lambda w: int(common.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    counts = Counter(w for i, t in rows if i % 3 for w in (t or "").split())
    for i, t in rows:
        alpha, log = m.start, 0.0
        for k, w in enumerate([*(t or "").split(), None]):
            h = None if w is None else word(w)
            sym = v.end if w is None else head.get(h, v.end + 1 + (h >> 52))
            if w is not None and h not in head:
                log += math.log10((counts[w] + 1) / (v.bucket_tokens[h >> 52] + v.bucket_words[h >> 52] + 1))
            alpha = (alpha @ m.move if k else alpha) * m.emit[sym]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[i] - log) < 1e-6


def test_scores_spread_over_links(spark):
    """Trust and distrust on a few hundred linked pages, in plain whole numbers."""
    rng = np.random.default_rng(9)
    tops = ["a.org", "b.net", "c.com", "d.io", "e.f.g.h.i.j.k.com"]
    hosts = [f"{'x.' * int(rng.integers(0, 3))}s{k}.{tops[k % 5]}" for k in range(80)] + ["a..b.com", "x" * 260 + ".q.com", "net"]
    rows = []
    for i in range(300):
        links = "".join(f'<a href="http{"s" * (k % 2)}://{hosts[int(rng.integers(len(hosts)))].upper()}/p">' for k in range(int(rng.integers(0, 5))))
        rows.append((i, f"http://{hosts[int(rng.integers(len(hosts)))]}/{['fr', 'de', 'en'][i % 3]}/x", links))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = {r.page_id: r for r in url_filter.judge(d).collect()}
    good, bad, edges = Counter(), Counter(), set()
    for i, _, links in rows:
        r = judged[i]
        if r.rule:
            (good if r.verdict == "allow" else bad)[r.host] += 1
        for part in links.split("://")[1:]:
            edges.add((r.host, part.split("/")[0].lower()))
    edges = {(a, b) for a, b in edges if a != b}
    known = {r.host for r in judged.values()} | {b for _, b in edges}
    for h in list(known):
        while len(h) <= 253 and h.split(".")[0] and h.count(".") >= 2:
            up = h.split(".", 1)[1]
            edges |= {(h, up), (up, h)}
            h = up
    nodes = known | {a for e in edges for a in e}
    outs, ins = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    t0 = {h: good[h] * url_filter.MASS // max(1, sum(good.values())) for h in nodes}
    d0 = {h: bad[h] * url_filter.MASS // max(1, sum(bad.values())) for h in nodes}
    t, x = dict(t0), dict(d0)
    for _ in range(url_filter.ROUNDS):
        nt, nx = Counter(), Counter()
        for a, b in edges:
            nt[b] += t[a] // outs[a]
            nx[a] += x[b] // ins[b]
        t, x = {h: (15 * t0[h] + 85 * nt[h]) // 100 for h in nodes}, {h: (15 * d0[h] + 85 * nx[h]) // 100 for h in nodes}
    free = [r for r in judged.values() if not r.rule]
    assert len(free) > 100 and len({r.verdict for r in free}) == 2
    assert all(r.verdict == ("block" if x[r.host] > t[r.host] else "allow") for r in free)


def test_windows_are_filled_by_bm25():
    rng = np.random.default_rng(12)
    docs = [(rng.zipf(1.5, rng.integers(3, 40)) % 60).astype(np.int64) for _ in range(50)]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(int(x) for d in docs for x in set(d.tolist()))
    weight = lambda x, d: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * (tf := int((d == x).sum())) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    left = [len(d) for d in docs]
    for own in packing.fill_windows(docs, 64):
        seed = own[0][0]
        assert seed == next(k for k in sorted(range(n), key=lambda k: -len(docs[k])) if left[k])
        terms = sorted((x for x in set(docs[seed].tolist()) if df[x] > 1), key=lambda x: -weight(x, docs[seed]))[: packing.QUERY_TERMS]
        score = {k: sum(weight(x, docs[k]) for x in terms) for k in range(n) if left[k] and k != seed}
        room = 64 - left[seed]
        left[seed] = 0
        ranked = sorted((k for k in score if score[k] > 0), key=lambda k: (-round(score[k], 9), k))
        whole = [k for k in ranked[: packing.WHOLE]]
        taken = []
        for k in whole:
            if left[k] <= room:
                taken.append(k)
                room -= left[k]
        assert [k for k, _, _ in own[1 : 1 + len(taken)]] == taken
        for k, _, size in own[1:]:
            left[k] -= size
    assert not any(left)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The workers start in a folder from which the package can't be imported."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert spark.sparkContext.parallelize([0]).map(lambda _: __import__("importlib").util.find_spec("tessera") is None).first()
sys.path.insert(0, {root!r})
from tessera.llm.registry import QUERIES
for name in ("op3_topk", "op5_minhash", "op7_hmm", "op8_exact_dedup", "op9_packing", "op10_langid"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


def test_search_by_hand():
    """One part, thresholds from none to beyond reach: found are the best exact products."""
    rng = np.random.default_rng(2)
    q, c = np.floor(rng.normal(size=(6, 12)) * 50), np.floor(rng.normal(size=(300, 12)) * 50)
    for theta in (-np.inf, 0.0, 9_000.0, 1e9):
        got = {}
        topk.search(q, np.full(6, theta), np.full(6, -1), c, np.arange(300), 4, lambda i, ids, s: got.setdefault(int(i), sorted(zip((-s).tolist(), ids.tolist(), strict=True))))
        for i in range(6):
            want = sorted((-float(s), k) for k, s in enumerate(c @ q[i]) if s >= theta)[:4]
            assert got.get(i, []) == want
