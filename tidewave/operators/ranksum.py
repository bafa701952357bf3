"""Rank-sum test of flagged against other values in each group, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.scalars import normal_cdf
from tidewave.operators.prefixsum import running_in_group


def rank_sum(rows: DataFrame, group: str, value: str, flag: str) -> DataFrame:
    """(group, m, n, u, p_value): whether flagged values are smaller; u counts, for each, the other values below it.

    Equal values are counted first, so the running count goes over distinct values, cut into
    ranges over tasks where a group has many. One-sided normal p-value; null where
    either side is empty. Null values don't count.
    """
    ties = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(flag).alias("c"), F.count_if(~F.col(flag)).alias("o"))
    sums = running_in_group(ties, [group], [value], {"below": F.col("o")}).groupBy(group).agg(F.sum("c").alias("m"), F.sum("o").alias("n"), F.sum(F.col("c") * F.col("below")).alias("u"))
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    z = (F.col("u") - m * n / 2) / F.sqrt(m * n * (m + n + 1) / 12)
    return sums.withColumn("p_value", F.when((m > 0) & (n > 0), normal_cdf(z)))
