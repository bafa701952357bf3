"""Interval joins by shared bins, and positions in the merged subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def clean_name(name: Column) -> Column:
    """Sequence name without its '>' and white space or carriage returns at its ends."""
    return F.regexp_replace(F.regexp_replace(name, r"^\s*>?\s*", ""), r"\s+$", "")


def from_bed(bed: DataFrame) -> DataFrame:
    """(name, start, stop) inclusive, of half-open rows (seq_name, start_pos, end_pos).

    Names are cleaned and swapped ends put right; empty intervals and rows with a null are left out, repeated ones kept once.
    """
    a, b = F.least("start_pos", "end_pos"), F.greatest("start_pos", "end_pos")
    rows = bed.where("seq_name is not null and start_pos is not null and end_pos is not null and start_pos <> end_pos")
    return rows.select(clean_name(F.col("seq_name")).alias("name"), a.alias("start"), (b - 1).alias("stop")).distinct()


def binned(df: DataFrame, start: str, stop: str, bin_size: int, prefix: str) -> DataFrame:
    first, last = F.floor(F.col(start) / bin_size), F.floor(F.col(stop) / bin_size)
    return df.withColumns({f"__{prefix}first": first}).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, ignore_name: bool = False, contained: bool = False, bin_size: int = BIN) -> DataFrame:
    """Pairs of rows (name, start, stop, ...) of `left` and `right` that share a position, ends inclusive.

    Rows meet in the bins they touch, an equi-join on (name, bin) that AQE splits where a bin is hot; each pair is kept only
    in the first bin both touch, so no distinct is needed. `contained`: the right row lies wholly within the left one.
    Rows with a null name (unless ignored) or end, or with start after stop, pair with nothing. Columns of the right side
    come with the prefix r_.
    """
    ok = (F.col("start") <= F.col("stop")) & (F.lit(ignore_name) | F.col("name").isNotNull())
    a = binned(left.where(ok), "start", "stop", bin_size, "l")
    b = binned(right.where(ok), "start", "stop", bin_size, "r")
    b = b.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns], F.col("__rfirst"), F.col("__bin").alias("__rbin"))
    same = F.col("__bin") == F.col("__rbin")
    if not ignore_name:
        same &= F.col("name") == F.col("r_name")
    test = (F.col("r_start") >= F.col("start")) & (F.col("r_stop") <= F.col("stop")) if contained else (F.col("r_stop") >= F.col("start")) & (F.col("r_start") <= F.col("stop"))
    pairs = a.join(b, same & test & (F.col("__bin") == F.greatest("__lfirst", "__rfirst")))
    return pairs.drop("__lfirst", "__rfirst", "__bin", "__rbin")


def stab_join(points: DataFrame, intervals: DataFrame, position: str, ignore_name: bool = False) -> DataFrame:
    """Pairs of points (name, position, ...) and the intervals that hold them."""
    p = points.withColumns({"start": F.col(position), "stop": F.col(position)})
    return overlap_join(p, intervals, ignore_name).drop("start", "stop")


def overlapping(left: DataFrame, right: DataFrame, key: str, ignore_name: bool = False, anti: bool = False) -> DataFrame:
    """Rows of `left` that overlap any row of `right`, or with `anti` none; `key` identifies the rows of `left`."""
    hit = overlap_join(left.select(key, "name", "start", "stop"), right.select("name", "start", "stop"), ignore_name).select(key).distinct()
    return left.join(hit, key, "left_anti" if anti else "left_semi")


def extent(intervals: DataFrame) -> DataFrame:
    """(start, stop): the least start and greatest stop; nulls for no intervals."""
    return intervals.agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def is_valid(intervals: DataFrame) -> bool:
    """Whether every interval has both ends, in order."""
    return intervals.where("start is null or stop is null or start > stop").isEmpty()


def sequence_spans(offsets: DataFrame, lengths: DataFrame) -> DataFrame:
    """(subject_id, seq_name, start, end) of each sequence of a subject, half-open, from cumulative exclusive ends.

    Ends that are null, not positive or beyond the subject's length (subject_id, n) are left out and repeated ends taken
    once with the least name, so sequences of no length vanish.
    """
    ends = offsets.join(lengths, "subject_id").where("end_pos > 0 and end_pos <= n").groupBy("subject_id", "end_pos").agg(F.min("seq_name").alias("seq_name"))
    start = F.coalesce(F.lag("end_pos").over(Window.partitionBy("subject_id").orderBy("end_pos")), F.lit(0))
    return ends.select("subject_id", "seq_name", start.alias("start"), F.col("end_pos").alias("end"))


def locate(matches: DataFrame, spans: DataFrame, position: str, bin_size: int = BIN) -> DataFrame:
    """Adds seq_name and local_pos of a position in its subject, by bins; positions outside every sequence give no row."""
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    s = s.select(F.col("subject_id").alias("__sid"), "seq_name", F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("__bin").alias("__sbin"))
    m = matches.withColumn("__bin", F.floor(F.col(position) / bin_size))
    on = (F.col("subject_id") == F.col("__sid")) & (F.col("__bin") == F.col("__sbin")) & (F.col(position) >= F.col("__start")) & (F.col(position) < F.col("__end"))
    return m.join(s, on).withColumn("local_pos", F.col(position) - F.col("__start")).drop("__sid", "__start", "__end", "__sbin", "__bin")
