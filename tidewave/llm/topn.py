"""The N best rows of every group, by a histogram threshold and an exact ranking of what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import BROADCAST_ROWS, broadcast_if_small, checkpointed

#: Groups of at most so many rows go to the ranking unfiltered: a threshold would cost more than it saves.
SMALL_GROUP = 64
SALTS = 16


def top_n_per_group(df: DataFrame, group: str, score: str, n: int, ties: list[Column], key: str, bucket: Column, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The `n` rows of lowest `score` of each non-null `group`, ties broken by `ties` and then `key`; each `key` counts once.

    `bucket` is any non-decreasing integer function of the score. Each (group, bucket) keeps a 64-bit set of hashed keys, whose
    size never exceeds the number of distinct keys, so the first bucket at which the running size reaches `n` is a safe
    threshold even when rows are repeated. Rows beyond it are dropped, keys are made unique (a shuffle on the key, so a hot
    group is spread over all tasks) and row_number() ranks the rest; Spark keeps n rows per group and task before the last
    shuffle, so neither a hot group nor a group of equal scores gathers in one task.

    A bucket's set counts at most 64 keys, so with `n` beyond 64 a group may need several buckets for a threshold, or, if its
    scores are all equal, finds none and is ranked whole: the rows are the same, only more of them reach the ranking.
    SMALL_GROUP and `broadcast_rows` also change the plan, not the rows.

    Null groups, null or NaN scores and null keys do not compete. Fewer than `n` rows: all of them. Empty input: no rows.
    Adds `rank` (1 to n); columns of the input that are called so are replaced.
    """
    g, s, k = F.col(group), F.col(score), F.col(key)
    rows = df.where(g.isNotNull() & s.isNotNull() & ~F.isnan(s.cast("double")) & k.isNotNull()).withColumn("__bucket", bucket.cast("int"))
    held = rows.groupBy(g.alias("__g"), "__bucket").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))).alias("__set"), F.count("*").alias("__n"))
    w = Window.partitionBy("__g")
    upto = held.withColumns({"__upto": F.sum(F.bit_count("__set")).over(w.orderBy("__bucket")), "__size": F.sum("__n").over(w)})
    limits = upto.where((F.col("__upto") >= n) & (F.col("__size") > SMALL_GROUP)).groupBy("__g").agg(F.min("__bucket").alias("__limit"))
    limits = checkpointed(limits)
    many = limits.count()
    if many <= broadcast_rows:
        rows = rows.join(broadcast_if_small(limits, many, broadcast_rows), g == F.col("__g"), "left")
    else:  # every group with a limit has more than SMALL_GROUP rows, so the copies stay below a quarter of the rows
        limits = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__s", F.pmod(F.xxhash64(k), F.lit(SALTS)).cast("int")).join(limits, (g == F.col("__g")) & (F.col("__s") == F.col("__salt")), "left")
    passed = rows.where(F.col("__limit").isNull() | (F.col("__bucket") <= F.col("__limit"))).select(*[F.col(f"`{c}`") for c in df.columns if c != "rank"])
    order = Window.partitionBy(group).orderBy(s.asc(), *ties, k.asc())
    return passed.dropDuplicates([key]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def best_matches(matches: DataFrame, n: int = 5) -> DataFrame:
    """Problem 5: the `n` best matches of each query by p_value, then match_ordinal (null and 0 last), then match_id."""
    valid = matches.select("query_number", "match_id", "p_value", "match_ordinal").where(F.col("p_value").between(0, 1) & ~F.isnan("p_value"))
    ordinal = F.nullif(F.col("match_ordinal"), F.lit(0))
    return top_n_per_group(valid, "query_number", "p_value", n, [ordinal.asc_nulls_last()], "match_id", F.floor(F.lit(256) * F.sqrt(F.sqrt("p_value"))))
