"""Ranges of a channel's samples during which its state is the wanted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.prefixsum import numbered_in_group, running_in_group
from tidewave.session import checkpointed


def state_ranges(rows: DataFrame, channel: str, order: list[str], state: Column, position: str, length: Column) -> DataFrame:
    """(channel, start, end) of each row in the wanted state, up to the next row's position, the last up to the signal's `length`.

    A range without samples runs to the next larger position instead. `length` is an aggregate over the channel, such as
    the greatest position plus one. Rows are numbered over tasks and meet the next one by an equi-join, so no channel gathers.
    """
    c = F.col(channel).alias("__c")
    lengths = rows.groupBy(c).agg(length.alias("__length"))
    each = checkpointed(numbered_in_group(rows.withColumn("__wanted", state), [channel], order).select(c, "__n", F.col(position).alias("__at"), "__wanted"))
    following = each.select(F.col("__c").alias("__fc"), (F.col("__n") - 1).alias("__fn"), F.col("__at").alias("__next"))
    wanted = each.where("__wanted").join(following, F.col("__c").eqNullSafe(F.col("__fc")) & (F.col("__n") == F.col("__fn")), "left")
    places = checkpointed(numbered_in_group(each.select("__c", "__at").distinct(), ["__c"], ["__at"], "__k"))
    larger = places.select(F.col("__c").alias("__lc"), (F.col("__k") - 1).alias("__lk"), F.col("__at").alias("__larger"))
    larger = places.join(larger, F.col("__c").eqNullSafe(F.col("__lc")) & (F.col("__k") == F.col("__lk"))).select("__lc", F.col("__at").alias("__lat"), "__larger")
    wanted = wanted.join(larger, F.col("__c").eqNullSafe(F.col("__lc")) & (F.col("__at") == F.col("__lat")), "left")
    wanted = wanted.join(lengths.withColumnRenamed("__c", "__tc"), F.col("__c").eqNullSafe(F.col("__tc")))
    end = F.coalesce("__next", "__length")
    return wanted.select(F.col("__c").alias(channel), F.col("__at").alias("start"), F.when(end > F.col("__at"), end).otherwise(F.coalesce("__larger", "__length")).alias("end"))


def average_in_bounds(rows: DataFrame, channel: str, order: list[str], value: str, lower: float, upper: float, window: int = 10) -> DataFrame:
    """(channel, in_strand): whether the mean of any `window` consecutive values lies within the bounds.

    Null values are none of the values, but take a place. Rows carry running totals over tasks and meet the row `window` places
    before them by an equi-join, so no channel gathers.
    """
    orders = [f"__o{i}" for i in range(len(order))]
    narrow = rows.select(F.col(channel).alias("__c"), *[F.col(o).alias(k) for o, k in zip(order, orders)], F.col(value).cast("double").alias("__v"))
    sums = {"__sum": F.coalesce("__v", F.lit(0.0)), "__many": F.col("__v").isNotNull().cast("bigint"), "__n": F.lit(1).cast("bigint")}
    each = checkpointed(running_in_group(narrow, ["__c"], orders, sums))
    upto = each.select("__c", "__n", (F.col("__sum") + F.coalesce("__v", F.lit(0.0))).alias("s"), (F.col("__many") + F.col("__v").isNotNull().cast("bigint")).alias("k"))
    first = each.select(F.col("__c").alias("__fc"), (F.col("__n") + window - 1).alias("__fn"), F.col("__sum").alias("s0"), F.col("__many").alias("k0"))
    both = upto.join(first, F.col("__c").eqNullSafe(F.col("__fc")) & (F.col("__n") == F.col("__fn")), "left")
    inside = (F.col("k") - F.col("k0") == window) & ((F.col("s") - F.col("s0")) / window).between(lower, upper)
    return both.groupBy(F.col("__c").alias(channel)).agg(F.max(F.coalesce(inside, F.lit(False))).alias("in_strand"))
