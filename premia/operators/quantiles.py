"""Exact quantiles, linear interpolation, by histogram refinement: nothing stored, no order shuffle.

Each value gets a 64-bit key whose order is the order of the values (``order_key``). A first pass
counts the values of every group and column by the key's top 16 bits; the wanted ranks (floor and
ceiling of p (n - 1)) fall into some of these bins. Each further pass reads only the rows of the
bins that hold a wanted rank (a join with that small table of bins) and counts them by the next
16 bits, until after four passes the whole key, and so the value itself, is known. Every pass is
a keyed count, combined on the map side, so a hot group or a hot value is summed in parts; a bin
table has at most 65,536 rows a group and column, whatever the data. The passes are lazy: the
quantiles are a plan; only the groups, where there are any, are counted while it is built. Up to
``_FEW_GROUPS`` of them, the small table of wanted bins is broadcast, so that no pass moves the
rows, and no task gets all the rows of a group; with more, rows meet it by (group, bin).

NaN is the largest value, -0.0 counts as 0.0. A group whose values are all missing has NULL
quantiles.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

_BITS = 16
_FEW_GROUPS = 2_000
_SHIFTS = (48, 32, 16, 0)
_MANTISSA = 1 << 52
_TINY = 2.0 ** -1022


def long_values(df, value_cols, by=()):
    """One row (by..., name, v) per non-missing value of each column."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
             for c in value_cols]
    rows = df.select(*by, F.explode(F.array(*pairs)).alias("pair"))
    keep = F.col("v").isNotNull()
    for key in by:
        keep = keep & F.col(key).isNotNull()
    return rows.select(*by, "pair.name", "pair.v").where(keep)


def order_key(v):
    """A bigint whose order is that of the double ``v``: sign times the IEEE bit pattern of |v|
    (exponent and mantissa found arithmetically, exactly), NaN above infinity. It is never NULL
    (0 for a NULL ``v``), so that no join works it out once more to drop NULL keys."""
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    exponent = (F.when(F.pow(F.lit(2.0), guess) > a, guess - 1)
                .when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess))
    normal = ((exponent + 1023) * F.lit(_MANTISSA)
              + ((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(_MANTISSA))).cast("bigint"))
    subnormal = (a * F.lit(2.0 ** 1022) * F.lit(float(_MANTISSA))).cast("bigint")
    size = (F.when(F.isnan(v), F.lit(0x7FF8 << 48))
            .when(a == F.lit(float("inf")), F.lit(0x7FF0 << 48))
            .when(a == 0, F.lit(0))
            .when(a < F.lit(_TINY), subnormal)
            .otherwise(normal)).cast("bigint")
    return F.coalesce(F.when(v < 0, -size).otherwise(size), F.lit(0).cast("bigint"))


def value_of_key(key):
    """The double whose ``order_key`` is the bigint ``key``."""
    size = F.abs(key)
    exponent, mantissa = F.shiftright(size, 52), size.bitwiseAND(F.lit(_MANTISSA - 1))
    share = mantissa.cast("double") / F.lit(float(_MANTISSA))
    v = (F.when(exponent == 0, share * F.lit(_TINY))
         .when(exponent < 0x7FF, (share + 1) * F.pow(F.lit(2.0), exponent - 1023))
         .when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return F.when(key < 0, -v).otherwise(v)


def quantiles(df, value_cols, probs, by=()):
    """``by`` columns plus, per value column, the array of its quantiles under its own name."""
    by, probs = list(by), [float(p) for p in probs]
    group = [*by, "name"]
    few = not by or (df.select(*by).dropna().distinct().limit(_FEW_GROUPS + 1).count()
                     <= _FEW_GROUPS)
    keyed = long_values(df, value_cols, by).select(*group, "v", order_key(F.col("v")).alias("key"))
    # Each level's table of wanted ranks is read once, by the next level, so the plan grows
    # linearly with the levels.
    bins = _count(keyed.withColumn("prefix", F.lit(0).cast("bigint")), group, _SHIFTS[0])
    bins = bins.withColumn("n", F.sum("rows").over(Window.partitionBy(*group)))
    asks = []
    for j, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        asks += [F.struct(F.lit(f"l{j}").alias("at"), F.floor(position).alias("rank")),
                 F.struct(F.lit(f"h{j}").alias("at"), F.ceil(position).alias("rank"))]
    wanted = _pick(bins.withColumn("asks", F.array(*asks)), group)
    for shift in _SHIFTS[1:]:
        chosen = wanted.groupBy(*group, "prefix").agg(
            F.max("n").alias("n"), F.collect_list(F.struct("at", "rank")).alias("asks"))
        # The table of chosen bins has at most 2 rows a probability, column and group.
        chosen = F.broadcast(chosen) if few else chosen
        rows = keyed.withColumn("prefix", F.shiftright("key", shift + _BITS)).join(
            chosen, [*group, "prefix"])
        wanted = _pick(_count(rows, group, shift, carried=("n", "asks")), group)
    found = wanted.groupBy(*group).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("at") == f"{s}{j}", F.col("v"))).alias(f"{s}{j}")
                                 for j in range(len(probs)) for s in "lh"])
    parts = []
    for j, p in enumerate(probs):
        position = F.lit(p) * (F.col("n") - 1)
        share = position - F.floor(position)
        low, high = F.col(f"l{j}"), F.col(f"h{j}")
        parts.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share))
    found = found.select(*group, F.array(*parts).alias("q"))
    wide = found.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in value_cols])
    if not by:
        return wide
    groups = df.select(*by).dropna().distinct()
    return groups.join(wide, by, "left")


def _count(rows, group, shift, carried=()):
    """Rows and a value of each bin ``key >> shift`` within its ``prefix``; ``carried`` columns
    are the same for a whole prefix. They are keys, as an array among the aggregates would make
    Spark sort all rows instead of counting them in a hash table."""
    return rows.groupBy(*group, "prefix", *carried, F.shiftright("key", shift).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("v").alias("v"))


def _pick(bins, group):
    """For each rank asked of a prefix (``asks``), its bin and the rank within that bin."""
    before = Window.partitionBy(*group, "prefix").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    asked = bins.select(*group, "n", "bin", "rows", "v", "below", F.explode("asks").alias("ask"))
    hit = asked.where((F.col("ask.rank") >= F.col("below"))
                      & (F.col("ask.rank") < F.col("below") + F.col("rows")))
    return hit.select(*group, "n", "ask.at", (F.col("ask.rank") - F.col("below")).alias("rank"),
                      F.col("bin").alias("prefix"), "v")
