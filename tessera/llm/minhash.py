"""Near duplicates by SuperMinHash signatures, banding, verification on full shingle sets and union by components."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Shelter, discard, lean, materialise, mix, table, text_words, with_columns

#: A pair at exactly the threshold shares no band with this probability at most; more similar pairs still less.
MISS = 5e-5
#: Groups of so many classes at most are compared as pairs that are joined with their sets; groups of so many classes and hashes in one task.
SMALL, MEET, MEET_HASHES = 4, 256, 1 << 22
#: Members of a larger group, about, whose majority is its pivot; members of a group that one copy of its pivot meets, about; hashes that
#: are counted at a time; links that a task unites at a time.
SAMPLE, SALT, COUNTED, UNITE = 16, 256, 1 << 14, 1 << 20
#: Bits of the map of ids whose texts are needed, 64 MB: with more than a sixteenth of so many ids more texts pass, and none is missed.
MOST_BITS, _BLOCK = 1 << 29, 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, rows: int = 6) -> tuple[int, int]:
    """Bands and rows of a band, so that a pair at the threshold misses all bands with probability MISS at most."""
    return max(1, int(np.ceil(np.log(MISS) / np.log1p(-(threshold**rows))))), rows


def shingle_sets(arr, n: int):
    """For each run of texts of an Arrow string array: its range [i, j), distinct shingle hashes sorted by text and value, and each text's first."""
    for i, j, w, doc in text_words(arr):
        texts = j - i
        count = np.bincount(doc, minlength=texts)
        ok = doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        h = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            h = mix(h * _GOLD + w[at + k])
        own = doc[at]
        first = np.cumsum(count) - count
        for c in range(1, n):  # texts of fewer words: the whole sequence is one shingle
            few = np.flatnonzero(count == c)
            g = np.full(len(few), np.uint64(c), np.uint64)
            for k in range(c):
                g = mix(g * _GOLD + w[first[few] + k])
            h, own = np.concatenate([h, g]), np.concatenate([own, few])
        order = np.argsort(h)
        order = order[np.argsort(own[order].astype(np.uint16 if texts < 65536 else np.int64), kind="stable")]
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        yield i, j, h, own, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=texts))])


def superminhash(h: np.ndarray, own: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures of m values each: value = level in the high 16 bits, random bits below.

    Each element draws, level by level, one place of a random permutation of the m places and offers level + random part there; a place
    keeps the least offer. All texts advance level by level together, and a text stops as soon as all its places hold offers of
    levels that are done, for later levels offer more. The permutation is a Fisher-Yates shuffle of which only the draws are stored.
    """
    sig = np.full(texts * m, np.iinfo(np.uint64).max, np.uint64)
    draws = np.zeros((len(h), 0), np.int16)
    for j in range(m):
        if not len(h):
            break
        x = mix(h + np.uint64(int(_GOLD) * (j + 1) % 2**64))
        k = (j + (((x & np.uint64(0xFFFF)) * np.uint64(m - j)) >> np.uint64(16)).astype(np.int64)).astype(np.int16)
        place = k.copy()
        for i in range(j - 1, -1, -1):
            place[draws[:, i] == place] = i
        np.minimum.at(sig, own * m + place, (np.uint64(j) << np.uint64(48)) | (x >> np.uint64(16)))
        full = sig.reshape(texts, m).max(axis=1) < (np.uint64(j + 1) << np.uint64(48))
        left = ~full[own]
        if left.all():
            draws = np.column_stack([draws, k])
        else:
            h, own, draws = h[left], own[left], np.column_stack([draws[left], k[left]])
    return sig.reshape(texts, m)


def _classes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit name of each set, as two 64-bit numbers."""
    count, x = np.diff(at), mix(h + np.uint64(77))
    s1, s2, some = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64), np.flatnonzero(np.diff(at))
    if len(some):
        s1[some], s2[some] = np.add.reduceat(x, at[:-1][some]), np.add.reduceat(mix(x ^ _GOLD), at[:-1][some])
    n = count.astype(np.uint64)
    return mix(s1 + n).view(np.int64), mix(mix(s2) + n).view(np.int64)


@lean
def _sketch(n: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            for i, j, h, own, at in shingle_sets(b.column(2), n):
                count = np.diff(at)
                sig = superminhash(h, own, j - i, bands * rows).reshape(j - i, bands, rows)
                keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (j - i, bands)).copy()
                for r in range(rows):
                    keys = mix(keys * _GOLD + sig[:, :, r])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                none = pa.array(count == 0)
                names = [pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(c)) for c in _classes(h, at)]
                own_bands = pa.compute.if_else(none, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(count.astype(np.int64)), *names, own_bands], ["id", "tag", "n", "c1", "c2", "bands"])

    return run


@lean
def _sets(n: int):
    """Of rows cls, c1, c2, text: the sets of the texts that are of the class so named."""

    def run(batches):
        for b in batches:
            c1, c2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j, h, _, at in shingle_sets(b.column(3), n):
                a1, a2 = _classes(h, at)
                ok = np.flatnonzero((a1 == c1[i:j]) & (a2 == c2[i:j]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(ok)), pa.array([h[at[k] : at[k + 1]].tobytes() for k in ok.tolist()], pa.binary())], ["cls", "hashes"])

    return run


@lean
def _same(percent: int):
    """Of rows u, v and their sets, those that are linked."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _meet(percent: int):
    """Of a group's rows cls, hashes: each class that is linked with others, over links in the group, with the smallest of them."""

    def run(t: pa.Table) -> pa.Table:
        cls = t.column("cls").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes").combine_chunks()]
        size = np.array([len(x) for x in sets])
        own, at = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        at = np.unique(at, return_inverse=True)[1]
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        both, a = np.zeros((len(sets), len(sets))), 0
        while a < len(at):
            e = int(np.searchsorted(at, at[a] + COUNTED))
            has = np.zeros((len(sets), min(COUNTED, int(at[e - 1] - at[a]) + 1)), np.float32)
            has[own[a:e], at[a:e] - at[a]] = 1
            both += has @ has.T
            a = e
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        root = np.arange(len(sets))[np.argsort(np.argsort(cls))]  # ranks of the classes
        while True:
            new = np.where(linked, root[None, :], len(sets)).min(axis=1)
            new = np.minimum(new, root)
            if (new == root).all():
                break
            root = new
        top = np.sort(cls)[root]
        return pa.table([pa.array(cls[top != cls]), pa.array(top[top != cls])], ["u", "v"])

    return run


def _majority(t: pa.Table) -> pa.Table:
    """The hashes that at least half of a group's sample have."""
    t = t.combine_chunks()
    h, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]), return_counts=True)
    return pa.table([t.column("grp").slice(0, 1), t.column("k").slice(0, 1), pa.array([h[2 * n >= t.num_rows].tobytes()], pa.binary())], ["grp", "k", "pivot"])


def _differ(batches):
    """Of rows grp, cls, n, k, hashes, pivot: pivot's size, how many of its hashes the set lacks, and where set and pivot differ, ascending."""
    for b in batches:
        size, lacks, diff = [], [], []
        for x, y in zip(b.column(4), b.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer() if y.is_valid else b"", np.uint64)
            d = np.setxor1d(x, y, assume_unique=True)
            size.append(len(y))
            lacks.append((len(d) + len(y) - len(x)) // 2)
            diff.append(d.view(np.int64))
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(d) for d in diff])]).astype(np.int32)), pa.array(np.concatenate(diff) if diff else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(size, pa.int64()), pa.array(lacks, pa.int64()), flat], ["grp", "cls", "n", "k", "np", "lacks", "diff"])


def _forest(batches):
    """Unites links u, v, UNITE at a time: each node that isn't the smallest of its tree, with that."""

    def unite(parts):
        ends = np.concatenate(parts)
        node, at = np.unique(ends, return_inverse=True)
        root = list(range(len(node)))
        for a, b in at.reshape(-1, 2).tolist():
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a != b:
                root[max(a, b)] = min(a, b)
        for k in range(len(root)):  # a root is smaller than its nodes
            root[k] = root[root[k]]
        top = node[np.array(root, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(node[top != node]), pa.array(top[top != node])], ["u", "v"])

    parts, seen = [], 0
    for b in batches:
        if b.num_rows:
            parts.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            seen += b.num_rows
        if seen >= UNITE:
            yield unite(parts)
            parts, seen = [], 0
    if parts:
        yield unite(parts)


def components(links: DataFrame) -> DataFrame:
    """From links u, v: every node with the smallest node reachable from it, as node and root.

    Union-find within each task first, which leaves a tree of at most one link a node. The trees of all tasks are united in rounds: each
    node takes the least root among its neighbours and then that root's own, so roots travel twice as far each round. Tables are written
    to the shared folder; only whether anything has changed reaches the driver.
    """
    tree = links.select("u", "v").mapInArrow(_forest, "u long, v long")
    both = materialise(tree.union(tree.select(F.col("v"), F.col("u"))).distinct(), "links")
    label = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "label")
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("__r"))
        least = label.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("__old"), F.least("root", "__r").alias("root"))
        up = label.select(F.col("node").alias("__n"), F.col("root").alias("__up"))
        new = materialise(least.join(up, F.col("root") == F.col("__n"), "left").select("node", "__old", F.least("root", F.coalesce("__up", "root")).alias("root")), "label")
        discard(label)
        if not new.filter("__old <> root").limit(1).count():
            discard(both)
            return new.select("node", "root")
        label = new


def _salted(small: DataFrame) -> DataFrame:
    """A row a group, with its size k, once for every SALT members: so that a large group's members meet it in many tasks."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"k div {SALT}")))).drop("k")


def _salt():
    return F.pmod(F.xxhash64(F.lit(3), "cls"), F.expr(f"k div {SALT} + 1"))


def _bitmap(t: pa.Table) -> pa.Table:
    """The bits of a block that are set."""
    bits = np.zeros(1 << _BLOCK, bool)
    bits[t.column("p").to_numpy() & ((1 << _BLOCK) - 1)] = True
    return pa.table([t.column("block").slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["block", "bits"])


def _likely(rows: DataFrame, wanted: DataFrame, own: str, other: str) -> DataFrame:
    """The rows whose own value is among the other of wanted, and a few more: by a map of hashed values that is broadcast, so that other rows
    aren't shuffled."""
    bits = 1 << _BLOCK
    while bits < min(MOST_BITS, 16 * wanted.count()):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.lit(21), F.col(c)), F.lit(bits).cast("long"))
    made = wanted.select(place(other).alias("p")).select(F.shiftright("p", _BLOCK).cast("int").alias("block"), "p").groupBy("block").applyInArrow(_bitmap, "block int, bits binary").toArrow()
    table_ = np.zeros((bits >> _BLOCK, 1 << _BLOCK >> 3), np.uint8)
    for b, x in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        table_[b] = np.frombuffer(x, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table_.reshape(-1))

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return rows.filter(F.col(own).isNotNull()).filter(there(place(own)))


def _open(tokens: DataFrame) -> DataFrame:
    """The groups (grp, g) of tokens that may have a link between two components: size k, s and t that tell the members, and the least w of
    all and of the odd ones."""
    more = tokens.groupBy("grp", "g").agg(
        F.count(F.lit(1)).alias("k"), F.min("colour").alias("lo"), F.max("colour").alias("hi"), F.min("w").alias("near"), F.min(F.when(F.col("is_odd"), F.col("w"))).alias("near_odd"),
        F.bit_xor(F.xxhash64("cls")).alias("s"), F.sum(F.pmod(F.xxhash64(F.lit(7), "cls"), F.lit(1 << 32))).alias("t"))
    return more.filter("lo < hi and near_odd is not null").drop("lo", "hi")


def _group_rows(sketch: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The distinct classes (c1, c2, rep) and their components: see near_duplicates()."""
    classes = sketch.filter("c1 is not null and id is not null").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    member = classes.select("cls", "n", F.explode("bands").alias("key"))
    bucket = materialise(member.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    shared = materialise(_likely(member, bucket, "key", "key").join(bucket, "key").withColumn("company", F.sum("k").over(Window.partitionBy("cls"))), "shared")
    heads = shared.groupBy("key").agg(F.max(F.struct("company", "n", "cls"))["cls"].alias("grp"))
    groups = materialise(shared.select("key", "cls", "n").join(heads, "key").select("grp", "cls", "n").distinct().withColumn("colour", F.col("cls")), "groups")
    colours = materialise(groups.select("cls").distinct().withColumn("colour", F.col("cls")), "colours")

    named = classes.join(colours.select(F.col("cls").alias("__c")), F.col("cls") == F.col("__c"), "left_semi").select("cls", "rep", "c1", "c2")
    sets = materialise(_likely(docs, named, "id", "rep").join(named, F.col("id") == F.col("rep")).select("cls", "c1", "c2", "text").mapInArrow(_sets(n), "cls long, hashes binary"), "sets")
    if sets.count() > named.count():  # rows that repeat with id and text
        sets = materialise(sets.groupBy("cls").agg(F.first("hashes").alias("hashes")), "sets")

    level, whole, seen = 0, 100 + percent, None
    while groups.limit(1).count():
        level += 1
        sizes = groups.groupBy(F.col("grp").alias("__g")).agg(F.count(F.lit(1)).alias("k"), F.min("colour").alias("__lo"), F.max("colour").alias("__hi"), F.sum("n").alias("total")).filter("__lo < __hi").select("__g", "k", "total")
        g = materialise(groups.join(sizes, F.col("grp") == F.col("__g")).drop("__g"), "open")

        # small groups: each pair of unlike colour and like size
        few = g.filter(F.col("k") <= SMALL).groupBy("grp").agg(F.collect_list(F.struct("cls", "n", "colour")).alias("m"))
        fits = lambda x, y: (y["cls"] > x["cls"]) & (y["colour"] != x["colour"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
        pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: fits(x, y)), lambda y: F.struct(x["cls"].alias("u"), y["cls"].alias("v")))))
        pairs = few.select(F.explode(pairs).alias("p")).select("p.u", "p.v").distinct()
        held = (F.col("k") > SMALL) & (F.col("k") <= MEET) & (F.col("total") <= MEET_HASHES)
        near = _likely(sets, g.filter((F.col("k") <= SMALL) | held), "cls", "cls")
        a, b = near.select(F.col("cls").alias("__a"), F.col("hashes").alias("x")), near.select(F.col("cls").alias("__b"), F.col("hashes").alias("y"))
        links = pairs.join(a, F.col("u") == F.col("__a")).join(b, F.col("v") == F.col("__b")).select("u", "v", "x", "y").mapInArrow(_same(percent), "u long, v long")

        # groups that one task holds: all members by counts of shared hashes
        middle = g.filter(held).join(a, F.col("cls") == F.col("__a")).select("grp", "cls", F.col("x").alias("hashes"))
        links = links.union(middle.groupBy("grp").applyInArrow(_meet(percent), "u long, v long"))

        # large groups: each member against the pivot
        large = g.filter((F.col("k") > SMALL) & ~held)
        some = bool(large.limit(1).count())
        if some:
            unit = F.shiftrightunsigned(F.xxhash64(F.lit(13), "grp", "cls"), 11) * F.lit(2.0**-53)
            drawn = large.filter(unit * F.col("k") < SAMPLE)
            own = lambda wanted: _likely(sets, wanted, "cls", "cls").withColumnRenamed("cls", "__c")
            sample = drawn.join(own(drawn), F.col("cls") == F.col("__c")).select("grp", "k", "hashes")
            pivots = materialise(sample.groupBy("grp").applyInArrow(_majority, "grp long, k long, pivot binary"), "pivots")
            full = large.withColumn("salt", _salt()).join(own(large), F.col("cls") == F.col("__c")).join(_salted(pivots), ["grp", "salt"], "left")
            differ = materialise(full.select("grp", "cls", "n", "k", "hashes", "pivot").mapInArrow(_differ, "grp long, cls long, n long, k long, np long, lacks long, diff array<long>"), "differ")
            far = differ.withColumn("w", whole * F.col("lacks") + percent * F.col("n")).withColumn("r", whole * F.col("np")).withColumn("salt", _salt())
            nearest = far.groupBy("grp").agg(F.min(F.struct("w", F.col("cls").alias("c"))).alias("first"), F.first("k").alias("k"))
            far = far.join(_salted(nearest), ["grp", "salt"])
            sure = F.col("w") + F.col("first.w") <= F.col("r")
            links = links.union(far.filter(sure & (F.col("cls") != F.col("first.c"))).select(F.col("cls").alias("u"), F.col("first.c").alias("v")))
        links = materialise(links, "linked")
        stale = [links, colours]
        at = lambda c: colours.select(F.col("cls").alias(f"__{c}"), F.col("colour").alias(f"c{c}"))
        ends = links.join(at("u"), F.col("u") == F.col("__u")).join(at("v"), F.col("v") == F.col("__v")).filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
        comp = components(ends)
        colours = materialise(colours.join(comp, F.col("colour") == F.col("node"), "left").select("cls", F.coalesce("root", "colour").alias("colour")), "colours")
        if not some:
            discard(*stale, groups, g)
            break

        # what may still be linked shares hashes where it differs from the pivot, as many as the least
        odd = far.filter(~sure).groupBy("grp").agg(F.min("w").alias("odd"), F.first("k").alias("k"))
        rows = far.join(_salted(odd), ["grp", "salt"]).join(colours.withColumnRenamed("cls", "__c"), F.col("cls") == F.col("__c")).withColumn("is_odd", ~sure)
        least = lambda near, near_odd: F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(F.col("is_odd"), near).otherwise(near_odd) - F.col("r")) / whole)).cast("int")
        rows = rows.withColumn("least", least(F.col("first.w"), F.col("odd"))).filter(F.size("diff") >= F.col("least"))
        rows = materialise(rows.select("grp", "cls", "n", "w", "r", "colour", "is_odd", "least", "diff"), "rows")
        stale.append(rows)
        own = ["grp", "cls", "n", "w", "r", "colour", "is_odd"]
        short = rows.select(*own, F.explode(F.slice("diff", F.lit(1), F.size("diff") - F.col("least") + 1)).alias("g"))
        alive = short.join(_open(short).select("grp", "g"), ["grp", "g"], "left_semi").select("grp", "cls").distinct()
        tokens = rows.join(alive, ["grp", "cls"], "left_semi").select(*own, "least", F.explode("diff").alias("g"))
        tokens = materialise(tokens, "tokens")
        stale.append(tokens)
        rare = F.sort_array(F.collect_list(F.struct("k", "g")))
        rows = tokens.join(_open(tokens).select("grp", "g", "k"), ["grp", "g"]).groupBy(*own, "least").agg(rare.alias("diff")).filter(F.size("diff") >= F.col("least"))
        tokens = rows.select(*own, F.size("diff").alias("live"), F.explode(F.slice("diff", F.lit(1), F.size("diff") - F.col("least") + 1)["g"]).alias("g"))
        tokens = materialise(tokens, "short")
        for _ in range(2):  # the members of a new group may need more than those of the old
            tokens = tokens.join(_open(tokens).select("grp", "g", "near", "near_odd"), ["grp", "g"]).filter(F.col("live") >= least(F.col("near"), F.col("near_odd"))).drop("near", "near_odd")
            stale.append(tokens)
            tokens = materialise(tokens, "short")
        more = _open(tokens).groupBy("k", "s", "t").agg(F.min(F.struct("grp", "g")).alias("m"))  # one of those with the same members
        if seen is not None:
            more = more.join(seen, ["k", "s", "t"], "left_anti")
        more = materialise(more, "more")
        seen = more.drop("m") if seen is None else seen.union(more.drop("m"))
        groups = tokens.join(more.select("m.grp", "m.g"), ["grp", "g"]).select(F.xxhash64("grp", "g", F.lit(level)).alias("grp"), "cls", "n", "colour")
        groups = materialise(groups, "groups")
        discard(*stale, tokens, pivots, differ, g)

    top = classes.select("c1", "c2", "cls", "rep").join(colours.withColumnRenamed("cls", "__c"), F.col("cls") == F.col("__c"), "left")
    top = materialise(top.select("c1", "c2", "rep", F.coalesce("colour", "cls").alias("root")), "roots")
    least = top.groupBy(F.col("root").alias("__root")).agg(F.min("rep").alias("component_id"))
    return top.join(least, F.col("root") == F.col("__root")).select(F.col("c1").alias("__1"), F.col("c2").alias("__2"), "root", "component_id")


def _rows(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, tag (a hash of the text), n, root (null where the row is linked with nothing) and component_id of each row."""
    bands, rows = banding(percent / 100)
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    kind = dict(d.dtypes)["id"]
    sketch = materialise(d.mapInArrow(_sketch(n, bands, rows), f"id {kind}, tag long, n long, c1 long, c2 long, bands array<long>"), "sketch")
    named = _group_rows(sketch, d, n, percent)
    one = F.col("id").isNotNull() & (F.col("c1") == F.col("__1")) & (F.col("c2") == F.col("__2"))
    out = sketch.drop("bands").join(named, one, "left")
    return out.select("id", "tag", "n", "root", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct n-word shingles (words `[^ \\t-\\r]+`, A-Z
    lower-cased). 1. Every text is reduced to a class of equal sets, with a name of 128 bits, and the keys of its SuperMinHash bands.
    Classes that share a band are candidates. 2. Each bucket belongs to the member with the most company over all its buckets; all
    buckets of one head are one group. Groups of MEET members at most are compared on full sets, in one task. 3. A larger group gets a
    pivot P, the hashes that most of a bounded sample of its members have, and each member's full set is reduced to its difference from P.
    Where A lacks a hashes of P and B lacks b, |A & B| = |P| - a - b + the number of hashes in both differences. So without any of these
    last, links depend on one number a member alone, and the member nearest to P is linked with all that have a link of that kind: these
    links are counted, not searched. 4. All other links need hashes in both differences, as many as the numbers of the two tell. Two
    members that share enough share one in short prefixes of any order. Members that share none there are done. Of the others, hashes that
    no link can need are left out and the rarest come first. Members that share one in prefixes of that order, if not all in one
    component yet, are a new group of half the size or so, and go to 2; groups of the same members are one.
    A group of k members costs k comparisons with its pivot; only in groups of bounded size are members compared with members.

    A text with fewer than n words has its whole sequence as its one shingle; a null text or one without words has none and is linked
    with nothing. A null id is a document that takes no part: component_id is null and kept is true. Rows with the same id are
    one node each for their texts and share kept; drop_near_duplicates() decides by row. An empty table gives an empty result. Other
    columns are not read.
    """
    out = _rows(docs, n, percent, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return with_columns(out, {"kept": F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True))})


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: one row of each group that near_duplicates() links, that of the smallest id.

    Decided by row, that is by id and text: rows that share an id stay unless their own texts are near copies. Of rows with the
    same id and text that are a group's best, one stays. Rows with a null id, or without a word, all stay. All columns are kept.
    """
    s = Shelter(docs)
    i, t = s(id_col), s(text_col)
    rows = materialise(_rows(s.df, n, percent, i, t).filter("root is not null").groupBy("root", "id", "tag").agg(F.count(F.lit(1)).alias("times")), "rows")
    best = rows.groupBy(F.col("root").alias("__root")).agg(F.min(F.struct("id", "tag")).alias("best"))
    marked = rows.join(best, F.col("root") == F.col("__root")).withColumn("kept", F.struct("id", "tag") == F.col("best"))
    marked = materialise(marked.filter("not kept or times > 1").select("id", "tag", "kept"), "gone")
    mine = (F.col(i) == F.col("id")) & (F.xxhash64(F.col(t).cast("string")) == F.col("tag"))
    out = s.df.join(marked, mine, "left_anti")
    if marked.filter("kept").limit(1).count():
        again = s.df.join(marked.filter("kept"), mine)
        again = again.groupBy("id", "tag").agg(F.first(F.struct(*s.df.columns)).alias("row")).select("row.*")
        out = out.unionByName(again)
    return s.back(out)


def op5_minhash(spark, sf_dir):
    """Near-duplicate components of all documents on 3-word shingles at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) >= 3 THEN list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]))
                      WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, k.c AS component_id, k.c = s.doc_id AS kept FROM s JOIN k USING (doc_id)
"""
