"""Queries of the problems tagged llm and their SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import packing, pieces, quantiles, runs, tokens, topn, truncation
from tidewave.session import broadcast_if_small, one_row_per_key, table, written

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(table(spark, d, "wqueue")).select("first_item_id", "last_item_id")


def p2_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(table(spark, d, "wqueue"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return one_row_per_key(table(spark, d, "wqueue").select("item_id", "m_channel_num", "queued_at", "m_reads"), "item_id").withColumn("day", F.to_date("queued_at"))


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    """(whole, m_channel_num, day, n, rank_error, percent, value): of each channel and day, and of each whole channel, joined from its days."""
    days = written(p3_summaries(spark, d))
    whole = quantiles.merged(days, ["m_channel_num"]).withColumn("day", F.lit(None).cast("date"))
    both = days.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)))
    return quantiles.percentiles(both, ["whole", "m_channel_num", "day"])


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Of each channel and day, and (day null) of each channel, whose summaries are joined from its days'."""
    return _percentiles(spark, d).drop("whole")


def p3_summaries(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.summaries(_samples(spark, d), ["m_channel_num", "day"], "m_reads")


def p3_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact rank of each percentile, of a channel and day and of a whole channel, is within one percent."""
    got = written(_percentiles(spark, d))
    asked = got.groupBy(F.col("whole").alias("w"), F.col("m_channel_num").alias("c"), F.col("day").alias("d"), "n").agg(F.array_sort(F.collect_list(F.struct("percent", "value"))).alias("asked"))
    each = _samples(spark, d).withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True))))
    own_day = F.when(~F.col("whole"), F.col("day"))
    rows = each.join(broadcast_if_small(asked, got.count()), (F.col("whole") == F.col("w")) & F.col("m_channel_num").eqNullSafe(F.col("c")) & own_day.eqNullSafe(F.col("d")))
    finite = F.filter("m_reads", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).cast("array<double>")
    many = lambda test: F.size(F.filter("x", test))
    rows = rows.select("w", "c", "d", "n", finite.alias("x"), F.explode("asked").alias("a"))
    counts = rows.select("w", "c", "d", "n", "a", many(lambda x: x < F.col("a.value")).alias("below"), many(lambda x: x <= F.col("a.value")).alias("upto"))
    counts = counts.groupBy("w", "c", "d", "n", F.col("a.percent").alias("percent")).agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / 100))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return counts.select("w", F.col("c").alias("m_channel_num"), F.col("d").cast("string").alias("day"), "percent", "n", (off <= 0.01 * F.col("n")).alias("within")).withColumnRenamed("w", "whole")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.boundaries(table(spark, d, "wqueue"), table(spark, d, "cdtw"), table(spark, d, "subject_offsets"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "wqueue"), table(spark, d, "cdtw"), table(spark, d, "subject_offsets"))


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each list that is cut up, whether its pieces cover it, fit and overlap as they must."""
    return pieces.covered(p4_pieces(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top(spark, d).select("query_number", "match_id")


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_matches(table(spark, d, "algo_datatypes")).drop("match_ordinal")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Of each document that is packed: whether all of its tokens are, in containers none of which is over capacity, and it is split only if it must be."""
    sizes = written(tokens.count_tokens(table(spark, d, "documents")))
    rows = written(packing.pack(sizes, "doc_id", "n_tokens"))
    over = rows.groupBy("container").agg(F.sum("size").alias("held")).select(F.col("container").alias("c"), (F.col("held") > packing.CAPACITY).alias("over"))
    each = rows.join(over, F.col("container") == F.col("c")).groupBy(F.col("doc_id").alias("id")).agg(F.sum("size").alias("placed"), F.count("*").alias("pieces"), F.bool_or("over").alias("over"))
    each = sizes.join(each, F.col("doc_id") == F.col("id"))
    must = F.ceil(F.col("n_tokens") / packing.CAPACITY)
    return each.select("doc_id", (F.col("placed") == F.col("n_tokens")).alias("whole"), (~F.col("over")).alias("fits"), (F.col("pieces") == must).alias("split_if_needed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.scored(table(spark, d, "documents")).where("cut_off").select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.shares(truncation.scored(table(spark, d, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_events, p3_percentiles, p3_summaries, p3_rank_errors, p4_found, p4_pieces, p4_cover, p5_found, p5_top, p6_ids, p7_containers, p7_fill, p8_found, p8_shares)}

BEST = """
  select query_number, match_id, p_value, match_ordinal, row_number() over (partition by query_number
    order by p_value, nullif(match_ordinal, 0) asc nulls last, match_id) as rank
  from (select distinct query_number, match_id, p_value, match_ordinal from algo_datatypes
        where query_number is not null and p_value between 0 and 1 and not isnan(p_value))"""

FINITE = """(select m_channel_num, cast(queued_at as date) as day, v from (select m_channel_num, queued_at, unnest(x) as v from
  (select item_id, any_value(m_channel_num) as m_channel_num, any_value(queued_at) as queued_at, any_value(m_reads) as x from wqueue group by item_id))
  where v is not null and isfinite(v))"""

SQL: dict[str, str] = {
    "p3_rank_errors": f"""select whole, m_channel_num, cast(day as varchar) as day, cast(percent as integer) as percent, n, true as within from (
  select false as whole, m_channel_num, day, count(*) as n from {FINITE} group by 2, 3 union all select true, m_channel_num, null, count(*) from {FINITE} group by 2),
  (select unnest([1, 5, 25, 50, 75, 95, 99]) as percent)""",
    "p7_fill": "select doc_id, true as whole, true as fits, true as split_if_needed from documents where text is not null and text <> ''",
    "p5_found": f"select query_number, match_id from ({BEST}) where rank <= 5",
    "p5_top": f"select query_number, match_id, p_value, cast(rank as integer) as rank from ({BEST}) where rank <= 5",
    "p4_cover": """
select 'wqueue' as tab, item_id, len(any_value(m_reads)) as n, true as fits, true as joined from wqueue where len(m_reads) > 4096 group by item_id
union all select 'cdtw', subject_id, len(sub), true, true from cdtw where len(sub) > 4096""",
    "p4_found": """
with lists as (select 'wqueue' as tab, item_id, any_value(m_reads) as x from wqueue where len(m_reads) > 4096 group by item_id
               union all select 'cdtw', subject_id, sub from cdtw where len(sub) > 4096),
samples as (select tab, item_id, unnest(x) as v, unnest(range(len(x))) as i, len(x) as n from lists),
present as (select tab, item_id, i, lag(i) over (partition by tab, item_id order by i) as before from samples where v is not null and not isnan(v))
select tab, item_id, i as cut_at from present where i - before > 10
union
select 'cdtw', s.subject_id, s.end_pos from subject_offsets s join cdtw c using (subject_id)
where len(c.sub) > 4096 and s.end_pos > 0 and s.end_pos < len(c.sub)""",
}
