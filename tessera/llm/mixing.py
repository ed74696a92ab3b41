"""Mixing sources to target weights by entropy balancing."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Shelter, discard, materialise, table

#: Newton steps on the dual at most (they end when every source is within half a word, or its bracket within NARROW; if they don't, it is an
#: error), and rounds that pass on what rounding has left over.
NEWTON_STEPS, NARROW, ROUNDS = 80, 1e-9, 6


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From source and source_size: each source's target.

    Sources in the order of their code points (null last) weigh weights, repeating, and share `share` times all sizes; none gets over
    `most` times its size, and the excess goes to the others by weight until none is above. That is the level v with
    sum(min(most * size, v * weight)) = share * total, found by sorting the sources by most * size / weight.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"(row_number() over (order by source asc nulls last) - 1) % {len(weights)}"))
    s = sizes.withColumn("__w", weight).withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("__full", F.coalesce(F.sum("__cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("__left", F.sum("__w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    s = s.withColumn("__v", F.when(F.col("__cap") / F.col("__w") > (F.col("__all") - F.col("__full")) / F.col("__left"), (F.col("__all") - F.col("__full")) / F.col("__left")))
    level = F.min("__v").over(Window.partitionBy())
    first = F.min(F.when(F.col("__v").isNotNull(), F.struct(F.col("__cap") / F.col("__w"), F.col("__v")))).over(Window.partitionBy())
    s = s.withColumn("__level", F.coalesce(first["__v"], level))
    return s.select("source", "source_size", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__level") * F.col("__w"))).alias("target"))


def _unit(seed):
    return F.shiftrightunsigned(F.xxhash64(seed, F.col("__id"), F.col("__size")), 11) * F.lit(2.0**-53)


def _copies(most: int, seed: int):
    """A document's copies: its rate exp(lambda * size / mean) up to `most`, rounded at random, then moved by each round so far."""
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("__size") / F.col("mean"))))
    start = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.least(F.lit(most), F.floor(rate + _unit(F.lit(seed))).cast("int")))

    def move(c, step):
        go = (F.abs(step["gap"]) >= F.col("__size")) & (F.col("__size") > 0) & (_unit(F.lit(seed + 1) + step["k"]) < step["p"])
        return F.when(go & (step["gap"] > 0) & (c < most), c + 1).when(go & (step["gap"] < 0) & (c > 0), c - 1).otherwise(c)

    return F.aggregate("steps", start, move)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """Adds size (words of the text), source_size, target and copies (0 to `most`) so that each source's words come near its target.

    Entropy balancing: of all rates r with sum(r * size) = target in each source and 0 <= r <= most, the one nearest to 1 in relative
    entropy is min(most, exp(lambda * size / mean size)). Its dual is solved for every source at once by Newton steps, kept inside a
    bracket; each step is one aggregation by source over the table of sources and sizes, which counts documents once. Rates are
    rounded by a seeded hash of id and size; what a source then lacks or has too much is passed on in rounds, each of which moves
    documents no longer than the gap by one copy with the probability that closes it. A round that makes it worse is taken back.
    Per-source state stays a DataFrame; nothing is collected.

    A null text has no words, and a document without words has size 0 and one copy. Null sources are one source. Rows that agree in id
    and size get the same copies. Reruns agree. An empty table gives an empty result. Input columns named as added ones, in any
    case, are replaced.
    """
    s = Shelter(docs)
    n = F.coalesce(F.regexp_count(F.col(s(text_col)), F.lit(WORD)), F.lit(0)).cast("long")
    sized = s.df.withColumn("__size", n)
    own = F.col(s(source_col)).cast("string")
    small = materialise(sized.select(F.col(s(id_col)).alias("__id"), own.alias("source"), "__size"), "sizes")
    per = small.groupBy("source").agg(F.sum("__size").alias("source_size"), F.avg("__size").alias("mean"))
    goal = source_targets(per.select("source", "source_size"), weights, share, most)
    state = goal.join(per.select(F.col("source").alias("__s"), F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-9)).alias("mean")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    state = materialise(state.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-800.0)).withColumn("hi", F.lit(800.0)).withColumn("steps", F.expr("cast(array() as array<struct<gap double, p double, k int>>)")), "state")

    def joined(st):
        return small.join(st.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    # a rate depends on source and size alone: steps go over these, and only rounding looks at documents
    grouped = materialise(small.groupBy("source", "__size").agg(F.count(F.lit(1)).alias("__n")), "grouped")

    def after(st, agg):
        return st.join(agg.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    def kept(old, st):
        new = materialise(st, "state")
        discard(old)
        return new

    for _ in range(NEWTON_STEPS):
        z = F.col("__size") / F.col("mean")
        raw = F.exp(F.least(F.lit(50.0), F.col("lam") * z))
        words = F.col("__size") * F.col("__n")
        rows = grouped.join(state.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        sums = rows.groupBy("source").agg(F.sum(F.least(F.lit(float(most)), raw) * words).alias("__f"), F.sum(F.when(raw < most, raw * z * words).otherwise(0.0)).alias("__d"))
        st = after(state.drop("near"), sums)
        st = st.withColumn("lo", F.when(F.col("__f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("__f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") + F.try_divide(F.col("target") - F.col("__f"), F.when(F.col("__d") > 0, F.col("__d")))
        middle = F.when(F.col("hi") > 100, F.greatest(F.lit(1.0), F.col("lo") * 3 + 1)).when(F.col("lo") < -100, F.least(F.lit(-1.0), F.col("hi") * 3 - 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        safe = F.when(step.isNotNull() & (step > F.col("lo")) & (step < F.col("hi")), step).otherwise(middle)
        near = (F.abs(F.col("__f") - F.col("target")) < 0.5) | (F.col("hi") - F.col("lo") < NARROW)
        st = st.withColumn("near", F.coalesce(near, F.lit(True))).withColumn("lam", F.round(F.when(F.col("near"), F.col("lam")).otherwise(safe), 12)).drop("__f", "__d")
        state = kept(state, st)
        if not state.filter(~F.col("near")).limit(1).count():
            break
    else:
        raise RuntimeError(f"rates have not converged after {NEWTON_STEPS} steps")

    def undo(st, k, gap):  # takes round k back where it has made the gap larger
        last = F.col("steps")[k]
        worse = F.abs(gap) > F.abs(last["gap"])
        none = F.struct(last["gap"].alias("gap"), F.lit(0.0).alias("p"), F.lit(k).alias("k"))
        return st.withColumn("__gap", F.when(worse, last["gap"]).otherwise(gap)).withColumn("steps", F.when(worse, F.concat(F.slice("steps", 1, k), F.array(none))).otherwise(F.col("steps")))

    for k in range(ROUNDS + 1):
        taken = joined(state).withColumn("__t", _copies(most, seed) * F.col("__size")).groupBy("source").agg(F.sum("__t").alias("__taken"))
        st = after(state, taken)
        gap = F.coalesce(F.col("target") - F.col("__taken"), F.lit(0.0))
        st = undo(st, k - 1, gap) if k else st.withColumn("__gap", gap)
        st = kept(state, st.drop("__taken"))
        if k == ROUNDS:
            state = st.drop("__gap")
            break
        can = (F.col("__size") > 0) & (F.col("__size") <= F.abs("__gap")) & F.when(F.col("__gap") > 0, F.col("__c") < most).otherwise(F.col("__c") > 0)
        room = joined(st).withColumn("__c", _copies(most, seed)).groupBy("source").agg(F.sum(F.when(can, F.col("__size")).otherwise(0)).alias("__room"))
        p = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.abs("__gap"), F.when(F.col("__room") > 0, F.col("__room")))), F.lit(0.0))
        step = F.struct(F.col("__gap").cast("double").alias("gap"), p.alias("p"), F.lit(k).alias("k"))
        state = kept(st, after(st, room).withColumn("steps", F.concat("steps", F.array(step))).drop("__gap", "__room"))
    final = state.select(F.col("source").alias("__s"), F.col("source_size").cast("long").alias("source_size"), "target", "lam", "mean", "steps")
    out = sized.withColumn("__id", F.col(s(id_col))).join(final, own.eqNullSafe(F.col("__s")), "left")
    out = out.withColumn("copies", _copies(most, seed)).withColumnRenamed("__size", "size")
    return s.back(out, "size", "source_size", "target", "copies")


def op6_mixing(spark, sf_dir):
    """Rates of all documents that bring each source's words near its target; taken counts repeats."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(d).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source")
