"""Running totals over an order without holding a group in one task."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from premia.storage import store


def rows_before(df, order, by=(), weight="1"):
    """Adds ``below``, the sum of ``weight`` over the rows of the group that come before, and
    ``n``, the sum over all of them.

    Rows are dealt to tasks by range of (``by``, ``order``), so a large group is spread over many
    and rows of one order value stay together; ``order`` should be total. Sums inside a range
    start from the total of the ranges before it, of which there are as many as partitions. The
    dealt rows are stored, as a range must mean the same rows to both sums. NULL keys are a
    group; NULL order values come first and NaN last, as in any sort.
    """
    by, order = list(by), list(order)
    dealt = store(df.repartitionByRange(*by, *order)
                  .withColumn("part", F.spark_partition_id()), "dealt")
    whole = Window.partitionBy(*by)
    first = Window.unboundedPreceding
    ahead = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(first, -1)), F.lit(0))
    parts = (dealt.groupBy(*by, "part").agg(F.sum(F.expr(weight)).alias("rows"))
             .select(*[F.col(c).alias(f"{c}__of") for c in by], F.col("part").alias("part__of"),
                     ahead.alias("ahead"), F.sum("rows").over(whole).alias("n")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__of"))
                                       for c in [*by, "part"]])
    inside = Window.partitionBy(*by, "part").orderBy(*order).rowsBetween(first, -1)
    below = F.col("ahead") + F.coalesce(F.sum(F.expr(weight)).over(inside), F.lit(0))
    return (dealt.join(parts, same).withColumn("below", below)
            .drop("part", "part__of", "ahead", *[f"{c}__of" for c in by]))
