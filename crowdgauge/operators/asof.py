"""As-of join without pairing every left row with every right row of a key.

The left side is first folded to its distinct (key, time) pairs, so a key that holds a third of all rows costs no
more than its different times. Both sides are then laid on one time line per (key, time bucket), at most two rows per
time, and the right-hand value is carried along it; the value current at the start of each bucket comes from a
second, tiny time line with one row per bucket. The left rows look their pair up by an equi-join, which
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str,
              value: list[str], *, forward: bool = False, allow_equal: bool = True,
              bucket: int = 400, prefix: str = "") -> DataFrame:
    """Left rows with the ``value`` columns of the nearest right row not after (or, with
    ``forward``, not before) them. ``left_at`` and ``right_at`` are integers, such as days.

    Right rows must be unique by (key, right_at).
    """
    sign = -1 if forward else 1
    # At equal times the right row must come first to be seen, or last to be hidden.
    side_right = 0 if allow_equal else 2
    payload = F.struct(F.col(right_at).alias("_at"), *value)
    r = right.filter(F.col(right_at).isNotNull()).select(
        *key, (F.col(right_at) * sign).cast("bigint").alias("_t"), F.lit(side_right).alias("_side"),
        payload.alias("_v"))
    rows = left.filter(F.col(left_at).isNotNull()).select(
        *key, F.col(left_at).cast("bigint").alias("_at_left")).distinct().select(
        *key, (F.col("_at_left") * sign).alias("_t"), F.lit(1).alias("_side"), F.col("_at_left").alias("_l"))
    both = r.unionByName(rows, allowMissingColumns=True).withColumn(
        "_b", F.floor(F.col("_t") / bucket))
    line = Window.partitionBy(*key, "_b").orderBy("_t", "_side")
    running = F.last("_v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_in", running).filter(F.col("_l").isNotNull())
    per_bucket = both.groupBy(*key, "_b").agg(F.max_by("_v", F.when(
        F.col("_v").isNotNull(), F.col("_t"))).alias("_last"))
    buckets = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*key, "_b", F.last("_last", ignorenulls=True).over(buckets).alias("_carry"))
    found = inside.join(carry, [*key, "_b"], "left").withColumn("_hit", F.coalesce("_in", "_carry")).select(
        *key, F.col("_l").alias("_at_left"), "_hit")
    return left.withColumn("_at_left", F.col(left_at).cast("bigint")).join(found, [*key, "_at_left"], "left").select(
        *left.columns, *[F.col(f"_hit.{v}").alias(prefix + v) for v in value],
        F.col("_hit._at").alias(prefix + right_at))


def day_number(date: Column | str) -> Column:
    return F.unix_date(F.col(date) if isinstance(date, str) else date)
