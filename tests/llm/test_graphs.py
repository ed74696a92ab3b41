"""Near copies, URLs, top-k, surrogates and the language model: odd rows, and brute force."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hmm, minhash, pii, registry, topk, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, cls string"


def shingles(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def texts(seed=2, n=160):
    """Families of near copies, changed in different places; short and empty texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(3000)]
    out = []
    for f in range(8):
        base = rng.choice(vocab, 40 + 30 * f).tolist()
        for _ in range(n // 8):
            t = list(base)
            for _ in range(rng.integers(0, 6)):
                t[rng.integers(len(t))] = str(rng.choice(vocab))
            out.append(" ".join(t) if rng.random() < 0.8 else " ".join(t[: int(len(t) * 0.9)]).upper())
    out += ["", None, " \n", "one", "One", "one two", "one two three four", "one two three four"]
    return [(int(i), t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, n, percent):
    rows = texts()
    d = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    want = brute(rows, n, percent)
    got = minhash.near_duplicates(d, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("n", "percent", "base_in"), [(3, 85, True), (5, 80, False)])
def test_near_copies_in_large_groups(spark, monkeypatch, n, percent, base_in):
    """Copies of two texts that share a third, changed in different places, cut or lengthened; groups over six are parted by pivots."""
    monkeypatch.setattr(minhash, "MEET", 6)
    monkeypatch.setattr(minhash, "SALT", 32)
    rng = np.random.default_rng(11)
    vocab, shared, rows = [f"w{k}" for k in range(2000)], None, []
    for size in (260, 120):
        base = rng.choice(vocab, 90).tolist()
        shared = shared or base[:30]
        base[:30] = shared
        for _ in range(size):
            t = list(base)
            for _ in range(rng.integers(1, 4)):
                t[rng.integers(len(t))] = str(rng.choice(vocab))
            if rng.random() < 0.2:
                t = t[: int(rng.integers(70, 90))]
            if rng.random() < 0.2:
                t += rng.choice(vocab, 8).tolist()
            rows.append(" ".join(t))
        rows += [" ".join(base)] * base_in
    rows = list(enumerate(rows))
    want = brute(rows, n, percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 10 < len({c for _, c in want.values()}) < 370


def test_near_copies_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b c d", None, None), (3, "a b c d", None, None), (3, "a b c d", None, None), (2, "a b c d", None, None), (9, "x " * 50_000, None, None)], SCHEMA)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == {(None, None, True): 1, (3, 2, False): 2, (2, 2, True): 1, (9, 9, True): 1}
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_superminhash_against_a_plain_shuffle():
    def plain(h, m):
        sig = [2**64 - 1] * m
        for e in h.tolist():
            p = list(range(m))
            for j in range(m):
                x = int(minhash.mix(np.array([(e + int(minhash._GOLD) * (j + 1)) % 2**64], np.uint64))[0])
                k = j + ((x & 0xFFFF) * (m - j) >> 16)
                p[j], p[k] = p[k], p[j]
                sig[p[j]] = min(sig[p[j]], j << 48 | x >> 16)
        return sig

    rng = np.random.default_rng(1)
    own = np.repeat([0, 1, 2], [1, 7, 60])
    h = rng.integers(0, 2**63, len(own)).astype(np.uint64)
    got = minhash.superminhash(h, own, 3, 20)
    assert [got[d].tolist() for d in range(3)] == [plain(h[own == d], 20) for d in range(3)]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    tidy = lambda d: sorted(map(tuple, d.astype(str).replace({"nan": "None", "<NA>": "None"}).itertuples(index=False)))
    assert tidy(got) == tidy(want)


def test_urls(spark):
    rows = [
        (1, "http://Www.A.example.NET/en/x?y#z", None), (2, "https://b.net/", '<a class="q" href="https://bad.com/x">'), (3, None, None), (4, "no scheme", ""), (5, "x://example.com/de/", None),
        (6, "http://sub.example.com/de", None), (7, "http://c.org/fr/1", "<a href=//good.com>"), (8, "http://bad.com/1", '<a href="http://b.net/p">'), (9, "http://good.com", None), (9, "http://good.com", None), (10, "http://net", None),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("x")).withColumn("good", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(d).collect()}
    assert got[1] == ("www.a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "/", "net/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][:3] == ("sub.example.com", "/de", None)
    assert got[7][2:] == ("org/fr/", "allow") and got[8][2:] == (None, "block") and got[9][2:] == (None, "allow") and got[10] == ("net", "", None, "allow")
    assert url_filter.judge(d.limit(0)).count() == 0


def neighbours(rows, k, step):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(256 * c) for c in x])
    out = {}
    for i in v:
        if i % step == 0:
            s = [(-sum(a * b for a, b in zip(q, y, strict=True)), j) for q in v[i][:1] for j, ys in v.items() if j != i for y in ys if len(y) == len(q)]
            out[i] = [(j, -m) for m, j in sorted(s)[:k]]
    return out


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 40)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rng.normal(size=8) * rng.choice([0.01, 1, 30])]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(100)] + [(600, [float("nan")] * 8), (605, None), (610, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (615, [1.0, 2.0]), (620, [0.0] * 8), (625, [float("inf")] * 8), (301, rows[7][1]), (301, rows[7][1]), (630, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("part", F.lit(1))
    got = defaultdict(list)
    for r in topk.top_products(d, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = {q: v for q, v in neighbours(rows, 5, 5).items() if v}
    assert dict(got) == want
    assert topk.top_products(d.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_topk_of_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0]), (3, [2.0, 9.0]), (4, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_products(d, F.col("vec_id") == 0, scale=1.0).orderBy("rank").collect()]
    assert got == [(1, 3, 9), (2, 2, 2), (3, 3, 2), (4, 1, 1)]


def test_topk_sends_queries_only_where_they_can_score(spark, monkeypatch):
    """Long vectors in one direction, and no query that faces away from it: buckets of short ones are out of every query's reach, so neither side is sent there."""
    monkeypatch.setattr(topk, "SEEDS", 40)
    rng = np.random.default_rng(6)
    rows = [(i, ([100.0, 0.0] if i < 60 else [float(x) for x in rng.normal(size=2) * 0.01])) for i in range(600)]
    d = spark.createDataFrame([(i, [v[0] + (1 + i % 7) * 0.1, v[1]]) for i, v in rows], "vec_id long, embedding array<double>")
    sent = []
    real = topk._search

    def spy(k, scale):
        run, seen = real(k, scale), spark.sparkContext.accumulator(0)
        sent.append(seen)

        def count(queries, part):
            seen.add(part.num_rows)
            return run(queries, part)

        return count

    monkeypatch.setattr(topk, "_search", spy)
    got = topk.top_products(d, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == 5 * 60 and 0 < sent[0].value < 300


def test_topk_beyond_floats(spark):
    rows = [(i, [1e9 + i, -3e8 * i]) for i in range(5)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_products(d, F.col("vec_id") == 0, scale=1.0).collect()}
    assert got == {(0, j): int(1e9) * (int(1e9) + j) for j in range(1, 5)}


PRIVATE = [
    (1, "mail Bob.X@Ex.com or bob.x@ex.com now, 42.144.35.254 end"), (2, "+1 (988) 555-2485 and 988-555-2485"), (3, "card 4041894974608795. 4041-8949-7460-8795"),
    (4, 'password=d72a491f71c7584344 token = "55cf1b56d3d000479a9bdb231e139ff0e3d87397"'), (5, "Mr. John Smith met Mrs. Anna Smith, Mr. Smith; Господин Иван Петров"), (6, None), (7, ""),
    (8, "nothing here 123 at 10:20, v1.2.3"), (9, "DE89 3704 0044 0532 0130 00 ssn 123-45-6789"), (9, "DE89 3704 0044 0532 0130 00 ssn 123-45-6789"),
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(c if k % 2 == 0 else c * 2 - 9 * (c > 4) for k, c in enumerate(d)) % 10 == 0


def test_surrogates(spark):
    d = spark.createDataFrame(PRIVATE, "doc_id long, text string").withColumn("n_entities", F.lit("x")).withColumn("type", F.lit("x"))
    rows = pii.pseudonymise(d).collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(PRIVATE) and got[6] is None and got[7] == "" and got[8] == PRIVATE[7][1]
    mails = re.findall(r"[\w.]+@[\w.]+", got[1])
    assert mails[0] == mails[1] and mails[0].endswith(".com") and "bob" not in mails[0] and "42.144" not in got[1]
    assert all(0 <= int(o) <= 255 for o in re.search(r"\d+\.\d+\.\d+\.\d+", got[1])[0].split("."))
    a, b = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", got[2])
    assert a == b and a != ("988", "555", "2485") and got[2].startswith("+1 (")
    cards = re.findall(r"[\d-]{16,19}", got[3])
    assert cards[0] == cards[1].replace("-", "") and cards[1].count("-") == 3 and luhn(cards[0]) and cards[0] != "4041894974608795"
    assert re.fullmatch(r'password=[0-9a-f]{18} token = "[0-9a-f]{40}"', got[4]) and "d72a" not in got[4]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+), Mr\. (\w+); Господин ([а-яА-Я]+) ([а-яА-Я]+)", got[5])
    assert m and m[2] == m[4] == m[5] and m[3].endswith("na") and m[1] != "John"
    iban = re.match(r"DE\d\d( \d{4}){4} \d\d", got[9])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.pseudonymise(d.limit(0)).count() == 0


def test_colliding_surrogates_are_drawn_again(spark):
    found = spark.range(60).select(F.lit("ssn").alias("type"), F.format_string("%09d", "id").alias("canon"))
    drawn = pii.surrogate("k", F.struct("type", "canon"), F.lit(0))
    clash = found.union(found.limit(1).select("type", drawn))  # a real entity that is another's first surrogate
    again = {r.canon: r.attempt for r in pii.dictionary(clash, "k").collect()}
    first = found.first()
    assert again.get(first.canon, 0) >= 1
    d = spark.createDataFrame([(1, "a 000-00-0000"), (2, "b 000-00-0001")], "doc_id long, text string")
    assert len({r.text[2:] for r in pii.pseudonymise(d, "k").collect()} - {"000-00-0000", "000-00-0001"}) == 2


def test_language_model_counts(spark):
    rows = [(1, "A b a"), (2, "b c"), (3, None), (4, ""), (5, "a zz"), (5, "a zz"), (None, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = hmm.language_model(d, F.col("doc_id") <= 2).collect()
    c = {"a": 2, "b": 2, "c": 1, None: 2}
    n, v = 7, 4
    want = Counter()
    for i, t in rows:
        toks = [w.lower() for w in (t or "").split()] + [None]
        base = sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in toks)
        want[(i, len(toks), sum(w in c for w in toks), n, round(base, 9))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == want
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert hmm.language_model(d.limit(0), F.col("doc_id") <= 2).count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(3)
    k, s = 3, 5
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((s, k)), 0))
    docs = [np.array([0, 1, 4, 2]), np.array([3, 4]), np.array([4])]

    def total(t):
        import itertools

        return sum(m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[x, z] for x, z in zip(t, p, strict=True)]) for p in itertools.product(range(k), repeat=len(t)))

    assert np.allclose(np.exp(hmm.forward(m, docs)[0]), [total(t) for t in docs])
    start, move, emits, like = hmm.expected(m, docs, s)
    assert np.isclose(start.sum(), 3) and np.isclose(move.sum(), 4) and np.isclose(emits.sum(), 7) and np.allclose(emits.sum(axis=1), [1, 1, 1, 1, 3])
    better = hmm.expected(hmm.Hmm(norm(start, 0), norm(move, 1), norm(emits, 0)), docs, s)[3]
    assert better >= like


def test_model_beats_unigrams_on_held_out_texts(spark):
    got = hmm.op7_hmm(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
