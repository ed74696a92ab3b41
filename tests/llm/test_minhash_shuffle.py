from tessera.llm import minhash


def test_lone_bands_are_not_joined(spark, monkeypatch):
    """Of the bands, only those that are likely to be shared reach the join that finds candidates; before, all were shuffled for it."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(300)] + [(i, " ".join(f"same{k}" for k in range(60)) + f" t{i}") for i in (300, 301)]
    seen, real = {}, minhash._likely

    def likely(d, wanted, own, other):
        out = real(d, wanted, own, other)
        if own == "key":
            seen.update(all=d.count(), sent=out.count(), wanted=wanted.count())
        return out

    monkeypatch.setattr(minhash, "_likely", likely)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(r.doc_id for r in got if not r.kept) == [301]
    assert 2 * seen["wanted"] <= seen["sent"] < seen["all"] / 4


def test_sets_of_other_classes_are_not_joined(spark, monkeypatch):
    """Of the full sets, only those of the classes that a join asks for are shuffled for it; before, all were, for each join of each round."""
    monkeypatch.setattr(minhash, "MEET", 32)
    pairs = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(60)) + f" t{j}") for i in range(200) for j in (0, 1)]
    many = [(1000 + i, " ".join(f"same{k}" for k in range(120)) + f" t{i}") for i in range(80)]
    seen, real = [], minhash._likely

    def likely(d, wanted, own, other):
        out = real(d, wanted, own, other)
        if own == "cls":
            seen.append((d.count(), out.count(), wanted.select("cls").distinct().count()))
        return out

    monkeypatch.setattr(minhash, "_likely", likely)
    got = minhash.near_duplicates(spark.createDataFrame(pairs + many, "doc_id long, text string"), 3, 85).collect()
    assert sorted(r.component_id for r in got if r.kept) == [*range(0, 400, 2), 1000]
    small, drawn, large = seen[:3]
    assert small[0] == drawn[0] == large[0] == 480
    assert 400 <= small[1] < 440 and 80 <= large[1] < 120 and drawn[2] <= drawn[1] < 80
