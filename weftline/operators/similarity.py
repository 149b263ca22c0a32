"""Near-equal hashes, and the best copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RADIUS = 6


def difference_hash(values: Column, bits: int = 63) -> Column:
    """Bits that tell whether each value is greater than its neighbour, the first lowest."""
    steps = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, i: a + F.when(F.get(values, i) > F.get(values, i + 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))


def near_hashes(df: DataFrame, radius: int = RADIUS, bits: int = 64) -> DataFrame:
    """(name, a, b, distance): distinct hashes of one name that differ in at most ``radius`` bits.

    Of two hashes that close, cut into radius + 1 bands, one band is equal: the search is an equi-join on
    (name, band), and pairs are of distinct hashes, not of the rows that bear them.
    """
    width = -(-bits // (radius + 1))
    h = df.where("hash <> 0").select("name", "hash").distinct()
    band = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("hash", i * width).bitwiseAND((1 << width) - 1).alias("part")) for i in range(radius + 1)])
    cut = h.select("name", "hash", F.inline(band))
    a, b = (cut.select("name", "band", "part", F.col("hash").alias(x)) for x in "ab")
    near = a.join(b, ["name", "band", "part"]).where("a < b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    return near.where(F.col("distance") <= radius).select("name", "a", "b", "distance").distinct()


def near_wide_hashes(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(name, a_hi, a_lo, b_hi, b_lo, distance): ``near_hashes`` of 128 bits in two halves, ``hash_hi`` and ``hash_lo``.

    The halves share the radius + 1 bands, so one band of one half is equal.
    """
    h = df.where("hash_hi <> 0 OR hash_lo <> 0").select("name", "hash_hi", "hash_lo").distinct()
    bands = []
    for half, n in (("hash_hi", (radius + 2) // 2), ("hash_lo", (radius + 1) // 2)):
        width = -(-64 // n) if n else 64
        mask = (1 << width) - 1 if width < 64 else -1
        bands += [F.struct(F.lit(f"{half}{i}").alias("band"), F.shiftrightunsigned(half, i * width).bitwiseAND(F.lit(mask).cast("bigint")).alias("part")) for i in range(n)]
    cut = h.select("name", "hash_hi", "hash_lo", F.inline(F.array(*bands)))
    a, b = (cut.select("name", "band", "part", F.col("hash_hi").alias(f"{x}_hi"), F.col("hash_lo").alias(f"{x}_lo")) for x in "ab")
    near = a.join(b, ["name", "band", "part"]).where("a_hi < b_hi OR (a_hi = b_hi AND a_lo < b_lo)")
    near = near.withColumn("distance", F.bit_count(F.col("a_hi").bitwiseXOR(F.col("b_hi"))) + F.bit_count(F.col("a_lo").bitwiseXOR(F.col("b_lo"))))
    return near.where(F.col("distance") <= radius).select("name", "a_hi", "a_lo", "b_hi", "b_lo", "distance").distinct()


def anchors(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, hash, anchor): each hash with the hash of the group that takes it, in order of ``first``.

    A hash is an anchor unless an earlier anchor is near; the others join their earliest near anchor. This is
    not the transitive closure. Found by rounds: a hash is settled once all its earlier neighbours are, so that each
    round settles at least the earliest open one; as many are made as the longest chain asks for.
    """
    from weftline.session import materialize

    both = pairs.select("name", F.col("a").alias("hash"), F.col("b").alias("other")).union(pairs.select("name", F.col("b").alias("hash"), F.col("a").alias("other")))
    first = hashes.select("name", "hash", "first")
    edges = both.join(first, ["name", "hash"]).join(first.select("name", F.col("hash").alias("other"), F.col("first").alias("other_first")), ["name", "other"]).where("other_first < first")
    edges = materialize(edges.select("name", "hash", "other", "other_first"), "near-edges")
    state = first.select("name", "hash", F.lit(None).cast("bigint").alias("anchor"))
    state = materialize(state, "anchors")
    while True:
        seen = edges.join(state.select("name", F.col("hash").alias("other"), F.col("anchor").alias("other_anchor")), ["name", "other"])
        agg = seen.groupBy("name", "hash").agg(
            F.min(F.when(F.col("other_anchor") == F.col("other"), F.struct("other_first", "other")))["other"].alias("near_anchor"),
            F.min(F.when(F.col("other_anchor").isNull(), F.col("other_first"))).alias("open_first"),
            F.min(F.when(F.col("other_anchor") == F.col("other"), F.col("other_first"))).alias("anchor_first"))
        step = state.join(agg, ["name", "hash"], "left")
        settled = F.coalesce("anchor", F.when(F.col("near_anchor").isNotNull() & (F.col("open_first").isNull() | (F.col("open_first") > F.col("anchor_first"))), F.col("near_anchor")).when(F.col("open_first").isNull() & F.col("near_anchor").isNull(), F.col("hash")))
        state = materialize(step.select("name", "hash", settled.alias("anchor")), "anchors")
        if state.where("anchor IS NULL").isEmpty():
            return state
