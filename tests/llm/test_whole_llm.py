"""Whole jobs of the training-data operators, where they once did a part."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import packing, pii


def test_all_forms_are_found(spark):
    texts = [
        "token=" + "aB3" * 100 + "!", "call +44 20 7946 0958 now", "call +33 1 42 68 53 00.", "call +49 30 901820.", "call 5551234567.", "pay 378282246310005 or 3782 822463 10005.", "pay NO93 8601 1117 947 now",
        "id 123456789012345 stays", "Dr. John Smith came. Smith said so; John's Smithson left. smith", "Smith came",
    ]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    out = [r["text"] for r in rows]
    assert [r["n_entities"] for r in rows] == [1, 1, 1, 1, 1, 2, 1, 0, 3, 0]
    assert [len(x) for x in out[:7]] == [len(x) for x in texts[:7]] and out[7] == texts[7] and out[9] == texts[9]
    assert out[0].endswith("!") and not any(out[0][i : i + 9] in texts[0] for i in range(6, 290))
    assert [re.sub(r"\d", "0", x) for x in out[1:6]] == [re.sub(r"\d", "0", x) for x in texts[1:6]] and all(a != b for a, b in zip(out[1:7], texts[1:7]))
    assert out[1].startswith("call +44 ") and out[2].startswith("call +33 ") and out[3].startswith("call +49 ")
    a, b = re.findall(r"\d{15}", re.sub(r"(\d) (?=\d)", r"\1", out[5]))
    assert a == b != "378282246310005" and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(a[::-1])) % 10 == 0
    given, family = re.match(r"Dr\. (\w+) (\w+) came", out[8]).groups()
    assert out[8] == f"Dr. {given} {family} came. {family} said so; {given}'s Smithson left. smith" and family != "Smith"


def test_neighbours_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the common words of all "), F.repeat(F.concat(F.lit(" Q"), F.pmod("id", F.lit(50)).cast("string")), 20)).alias("text")).repartition(3)
    rows = packing.pack(d).collect()
    assert sorted(r["doc_id"] for r in rows if r["start"] == 0) == list(range(400))
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    shards = defaultdict(Counter)
    for r in rows:
        if r["start"] == 0:
            shards[r["doc_id"] % 50][r["sequence_id"] >> 32] += 1
    assert sum(max(c.values()) for c in shards.values()) > 0.75 * 400


def test_one_person_has_one_name_under_all_titles(spark):
    texts = ["Dr. John Smith met Mr. John Smith. John Smith left.", "Prof. Carmen Diaz", "Mrs. Carmen Diaz", "Carmen Diaz", "Mr. Kim Lee", "Mrs. Kim Lee and Mr. Luca Lee", "Dr. Luca Lee"]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    a = re.fullmatch(r"Dr\. (\w+ \w+) met Mr\. (\w+ \w+)\. (\w+ \w+) left\.", out[0])
    assert len(set(a.groups())) == 1 and "John" not in out[0] and "Smith" not in out[0]
    carmen = [re.search(r"(\w+) \w+$", t)[1] for t in out[1:3]]
    assert carmen[0] == carmen[1] != "Carmen" and carmen[0].endswith("na") and out[3] == texts[3]
    kim = [re.search(r"Mrs?\. (\w+)", t)[1] for t in out[4:6]]
    assert kim[0] == kim[1] and kim[0][-1] in "aeio" and not kim[0].endswith("na")
    assert re.search(r"Mr\. (\w+) (\w+)$", out[5]).groups() == re.search(r"Dr\. (\w+) (\w+)$", out[6]).groups() and out[6].split()[1].endswith("n")


def test_few_forms_still_give_distinct_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    real = [f"{a}@{b}.co" for a in letters for b in letters]
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(real)), "doc_id int, text string")).collect()]
    assert len(set(out)) == 676 and not set(out) & set(real) and all(x.endswith(".co") for x in out)


def test_odd_characters_long_texts_and_clashing_names(spark):
    long = "x" * 100 + "@" + "sub." * 40 + "org"
    rows = [(1, "\x00 a@b.org \x01\x02 c\x00"), (2, "token: -------- and token: ----a---"), (3, f"mail {long} end"), (4, "word " * 300_000 + "Mr. Long Tail"), (5, None), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row", "2 AS N_Entities", "3 AS hits")
    rows = pii.pseudonymise(d).collect()
    assert [c for c in rows[0].asDict()] == ["doc_id", "text", "row", "hits", "n_entities"] and len(rows) == 6
    got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in rows}
    assert re.fullmatch("\x00 [a-z]@[a-z].org \x01\x02 c\x00", got[1][0]) and got[1][1] == 1
    assert got[2][0].startswith("token: -------- and token: ----") and got[2][1] == 1 and "----a---" not in got[2][0]
    assert got[3][1] == 1 and "sub." not in got[3][0] and got[3][0].endswith(".org end") and got[4][1] == 1 and "Tail" not in got[4][0] and got[5] == (None, 0)
