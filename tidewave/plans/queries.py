"""The registered queries of the core and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import encode as en
from tidewave.operators import anchors as an
from tidewave.operators import chains as ch
from tidewave.operators import decide, dtw, intervals, normalize, prefix, rank, ranksum, segment, spikes, states, subject
from tidewave.plans import oracle
from tidewave.plans.search import Settings, search
from tidewave.session import checkpointed, new_folder, one_row_per_key, remove_folder, spread, table
from tidewave.sources.stream import channel_range, chunk_stream
from tidewave.streaming.live import live, read_decisions
from tidewave.streaming.online import channel_states, chunk_states, in_strand, ring_buffer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The signal queue, each item once."""
    return one_row_per_key(table(spark, d, "wqueue").select("item_id", *columns), "item_id")


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Valid match records, each once."""
    names = ["match_id", "query_number", "subject_id", "p_value", "left_anchor_query", "right_anchor_query", "left_anchor_subject", "right_anchor_subject", "num_anchors"]
    rows = table(spark, d, "algo_datatypes").select(*names).where("query_number is not null and p_value between 0 and 1 and not isnan(p_value)").dropDuplicates(["match_id"])
    return rows.withColumn("p_value", F.col("p_value").cast("double"))


# problem 1


@query
def p1_found(spark, d):
    return p1_flags(spark, d).select("item_id", "first_sample")


@query
def p1_flags(spark, d):
    return spikes.flagged(table(spark, d, "wqueue"), table(spark, d, "channels"))


# statistics and normalisation


def readings(spark: SparkSession, d: str, key: str) -> DataFrame:
    """(key, v): samples that a converter can give."""
    rows = items(spark, d, "m_reads", *({key} - {"item_id"})).select(key, F.explode("m_reads").alias("v"))
    return rows.where("not isnan(v) and abs(v) < 1e6").withColumn("v", F.col("v").cast("double"))


def rounded_stats(df: DataFrame) -> DataFrame:
    """To four digits, off the ties that means of whole numbers often are."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("mean", "sd")})


@query
def stats_items(spark, d):
    return rounded_stats(normalize.stats(readings(spark, d, "item_id"), ["item_id"], "v"))


@query
def stats_channels(spark, d):
    return rounded_stats(normalize.stats(readings(spark, d, "m_channel_num").where("m_channel_num is not null"), ["m_channel_num"], "v"))


@query
def znorm_local(spark, d):
    return rounded(normalize.znorm_local(table(spark, d, "events"), "user_id", "value"), "z").select("event_id", "user_id", "z")


@query
def znorm_global(spark, d):
    return rounded(normalize.znorm_global(table(spark, d, "events"), "value"), "z").select("event_id", "z")


@query
def znorm_percentile(spark, d):
    return rounded(normalize.percentile_align(table(spark, d, "events"), "user_id", "value"), "z").select("event_id", "z")


@query
def rescale_to_subject(spark, d):
    events = table(spark, d, "events")
    to = normalize.stats(events, [], "value").first()
    s = normalize.stats(events, ["user_id"], "value").select(F.col("user_id").alias("u"), "mean", "sd")
    z = normalize.rescale(F.col("value"), F.col("mean"), F.col("sd"), F.lit(to["mean"]), F.lit(to["sd"]))
    return rounded(events.join(s, F.col("user_id") == F.col("u")).select("event_id", z.alias("z")), "z")


@query
def welford_rolling(spark, d):
    return rounded(normalize.welford(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"), "z").select("event_id", "z")


@query
def strided_sample(spark, d):
    return normalize.strided_sample(table(spark, d, "events"), "event_id", 16, "value")


@query
def sorted_distance_sample(spark, d):
    """Of each query block, the least distances in every fourth bucket of the events, sorted."""
    found = an.anchors(event_tiles(spark, d, 10, 64), an.query_blocks(vectors(spark, d), 10), 10, bucket=64)
    return rounded(normalize.sorted_sample(found, 4), "dist", digits=4)


# subjects


@query
def merge_offsets(spark, d):
    return subject.merge_offsets(table(spark, d, "cdtw"), "subject_id", "sub")


@query
def subject_long(spark, d):
    return subject.long_form(table(spark, d, "cdtw"), "subject_id", "sub").where("value is not null and not isnan(value)")


def spans(spark: SparkSession, d: str) -> DataFrame:
    return intervals.sequence_spans(table(spark, d, "subject_offsets"), table(spark, d, "cdtw").select("subject_id", F.size("sub").alias("n")))


@query
def sequence_spans(spark, d):
    return spans(spark, d)


@query
def locate_position(spark, d):
    return intervals.locate(matches(spark, d), spans(spark, d), "left_anchor_subject").select("match_id", "seq_name", "local_pos")


# intervals


def located(spark: SparkSession, d: str) -> DataFrame:
    """(match_id, name, start, stop) of each match within its sequence."""
    rows = intervals.locate(matches(spark, d), spans(spark, d), "left_anchor_subject").where("seq_name is not null")
    stop = F.col("local_pos") + F.col("right_anchor_subject") - F.col("left_anchor_subject")
    return rows.select("match_id", intervals.clean_name(F.col("seq_name")).alias("name"), F.col("local_pos").alias("start"), stop.alias("stop"))


def bed(spark: SparkSession, d: str) -> DataFrame:
    return intervals.from_bed(table(spark, d, "bed_intervals"))


@query
def interval_overlap(spark, d):
    return intervals.overlap_join(located(spark, d), bed(spark, d)).select("match_id", "name", "r_start", "r_stop")


@query
def interval_overlap_any_name(spark, d):
    return intervals.overlap_join(located(spark, d), bed(spark, d), ignore_name=True).groupBy("match_id").agg(F.count("*").alias("n"))


@query
def interval_overlap_any_name_all(spark, d):
    """The same under its older name."""
    return interval_overlap_any_name(spark, d)


@query
def interval_contained(spark, d):
    return intervals.overlap_join(bed(spark, d), located(spark, d), contained=True).select("name", "start", "stop", "r_match_id")


@query
def interval_stab(spark, d):
    return intervals.stab_join(located(spark, d).select("match_id", "name", F.col("start").alias("at")), bed(spark, d), "at").select("match_id", "r_start", "r_stop")


@query
def interval_semi(spark, d):
    return intervals.overlapping(located(spark, d), bed(spark, d), "match_id").select("match_id")


@query
def interval_anti(spark, d):
    return intervals.overlapping(located(spark, d), bed(spark, d), "match_id", anti=True).select("match_id")


@query
def interval_extent(spark, d):
    return intervals.extent(bed(spark, d))


# ranks


@query
def rank_competition(spark, d):
    return rank.ranked(matches(spark, d)).select("match_id", "query_number", "rank")


@query
def rank_dense(spark, d):
    return rank.ranked(matches(spark, d)).select("match_id", "query_number", "dense_rank")


@query
def fdr_plain(spark, d):
    return rounded(rank.fdr(matches(spark, d)), "q", digits=9).select("match_id", "q")


@query
def fdr_monotone(spark, d):
    return rounded(rank.fdr_monotone(matches(spark, d)), "q", digits=9).select("match_id", "q")


@query
def matches_limited(spark, d):
    return rank.limited(matches(spark, d), 0.05, 0.2, 3).select("match_id", "query_number", "rank")


@query
def matches_sorted(spark, d):
    return rank.sorted_matches(matches(spark, d)).select("match_id", *rank.SORT)


@query
def decisions(spark, d):
    rows = matches(spark, d)
    hit = intervals.overlapping(located(spark, d), bed(spark, d), "match_id").select("match_id", F.lit(True).alias("hit"))
    rows = rows.join(hit, "match_id", "left").withColumn("overlap", F.coalesce("hit", F.lit(False)))
    chunks = table(spark, d, "algo_datatypes").select("query_number").where("query_number is not null").distinct()
    return decide.decisions(chunks, rows, "query_number", overlap="overlap")


@query
def decisions_negative(spark, d):
    chunks = table(spark, d, "algo_datatypes").select("query_number").where("query_number is not null").distinct()
    return decide.decisions(chunks, matches(spark, d), "query_number", 0.001, negative=True)


@query
def rank_sum(spark, d):
    rows = table(spark, d, "events").withColumn("chosen", F.col("event_type") == "click")
    return rounded(ranksum.rank_sum(rows, "user_id", "value", "chosen"), "p_value", digits=5)


# encoding


@query
def kmer_index(spark, d):
    seq = en.clean_bases("text", rna=True)
    rows = spread(table(spark, d, "documents")).where("text is not null").select("source", F.explode(en.kmer_indexes(seq, en.RNA)).alias("kmer"))
    return rows.groupBy("source", "kmer").agg(F.count("*").alias("n"))


@query
def revcomp(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(en.reverse_complement(en.clean_bases("text"))).alias("digest"))


@query
def encode_signal(spark, d):
    """Texts as nucleotides through a model read off the events: their mean value by number modulo the k-mers."""
    model = table(spark, d, "events").groupBy((F.col("event_id") % 4**en.RNA).cast("int").alias("kmer_idx")).agg(F.avg("value").alias("mean"))
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("sequence")))
    return totals(en.encode(docs, model, rna=True, complement=True))


def dna_model(spark: SparkSession, d: str) -> DataFrame:
    """A k-mer model read off the events: mean and deviation of their values by number modulo the k-mers."""
    return table(spark, d, "events").groupBy((F.col("event_id") % 4**en.DNA).cast("int").alias("kmer_idx")).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"))


def totals(coded: DataFrame) -> DataFrame:
    """(doc_id, n, total) to two digits, off the ties that sums of short decimals often are."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))
    return rounded(coded.select("doc_id", F.size("values").alias("n"), (total + 1e-5).alias("total")), "total", digits=2)


@query
def encode_signal_dna(spark, d):
    """Texts as DNA, both strands."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("sequence")))
    return totals(en.encode(docs, dna_model(spark, d), complement=True))


@query
def encode_signal_complement_sd(spark, d):
    """Texts as DNA: deviations along the complementary strand alone."""
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("sequence")))
    return totals(en.encode(docs, dna_model(spark, d), signal_type=1, forward=False, complement=True))


@query
def prefix_unique(spark, d):
    names = table(spark, d, "subject_offsets").where("seq_name is not null").select(F.col("seq_name").alias("name")).distinct()
    return prefix.unique_prefixes(names.withColumn("seq", F.upper("name")), "name", "seq")


# alignment


def event_tiles(spark: SparkSession, d: str, size: int, bucket: int = subject.BUCKET) -> DataFrame:
    rows = table(spark, d, "events").withColumn("series", F.lit(0).cast("bigint"))
    return subject.ordered_tiles(rows, "series", "event_id", "value", size, bucket)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Query series: every vector whose id is divisible by 100, in the events' scale."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("values"))


@query
def mini_dtw_hard(spark, d):
    return rounded(an.anchors(event_tiles(spark, d, 10), an.query_blocks(vectors(spark, d), 10), 10), "dist", digits=4).select("query_id", "bucket", "block", "pos", "dist")


@query
def mini_dtw_soft(spark, d):
    return rounded(an.anchors(event_tiles(spark, d, 12), an.query_blocks(vectors(spark, d), 12), 12, 3), "dist", digits=4).select("query_id", "bucket", "block", "pos", "dist")


@query
def mini_dtw_deviation(spark, d):
    """The hard alignment with deviations on both sides: of an event its number modulo 7, of a query sample 3."""
    rows = table(spark, d, "events").withColumns({"series": F.lit(0).cast("bigint"), "sd": (F.col("event_id") % 7).cast("double")})
    tiles = subject.ordered_tiles(rows, "series", "event_id", "value", 10, std="sd")
    blocks = an.query_blocks(vectors(spark, d).withColumn("sd", F.transform("values", lambda x: F.lit(3.0))), 10, std="sd")
    return rounded(an.anchors(tiles, blocks, 10), "dist", digits=4).select("query_id", "bucket", "block", "pos", "dist")


@query
def collinear_pairs(spark, d):
    return ch.collinear_pairs(an.anchors(event_tiles(spark, d, 10, 64), an.query_blocks(vectors(spark, d), 10), 10, bucket=64), 10).drop("subject_id")


@query
def chain_extents(spark, d):
    found = ch.searched(event_tiles(spark, d, 10, 64), an.query_blocks(vectors(spark, d), 10), 10, bucket=64)
    return found.where(F.col("kind") == ch.CHAIN).drop("kind", "anchors", "dists")


@query
def dtw_pairs(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(dtw.distances_to_all(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding"), "distance")


@query
def nearest_window(spark, d):
    subjects = table(spark, d, "cdtw")
    return rounded(dtw.nearest_windows_to_all(lambda size: subject.tiles(subjects, "subject_id", "sub", size), vectors(spark, d)), "dist")


@query
def dtw_open_pairs(spark, d):
    """Vectors whose id is divisible by 100 against all, leading and trailing samples of the other one left out at no cost."""
    e = table(spark, d, "embeddings")
    return rounded(dtw.distances_to_all(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", open_start=True, open_end=True), "distance")


@query
def stitched_pairs(spark, d):
    """Each vector whose id is divisible by 100 with the vector after it, aligned piece by piece between anchors at every sixteenth sample."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = F.sequence(F.lit(0), F.lit(64), F.lit(16))
    pairs = e.where("vec_id % 100 = 0").select("vec_id", F.col("v").alias("query"), F.transform(at, lambda i: F.struct(i.cast("int").alias("q"), i.cast("bigint").alias("s"))).alias("anchors"))
    pairs = pairs.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("subject")), "vec_id")
    return rounded(dtw.stitched(pairs).select("vec_id", "cost"), "cost")


@query
def latest_samples(spark, d):
    """The last 100 samples of each item behind a buffer that held the item's own first ten."""
    rows = items(spark, d, "m_reads").where("size(m_reads) > 0").select("item_id", F.transform("m_reads", lambda x: F.coalesce(x, F.lit(float("nan"))).cast("double")).alias("x"))
    held = ring_buffer(F.slice("x", 1, 10), F.col("x"), 100)
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.when(F.isnan(x) | (F.abs(x) >= 1e6), 0.0).otherwise(x))
    return rounded(rows.select("item_id", F.size(held).alias("n"), total.alias("total")), "total", digits=3)


@query
def segments(spark, d):
    return segment.segmented(items(spark, d, "m_reads"), "item_id", "m_reads", 6)


def subjects_and_queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Subjects, and as queries the items, each once."""
    s = table(spark, d, "cdtw").select("subject_id", F.col("sub").alias("values"))
    q = items(spark, d, "m_reads").select(F.col("item_id").alias("query_id"), F.col("m_reads").alias("values"))
    return s, q


@query
def search_matches(spark, d):
    return search(*subjects_and_queries(spark, d), Settings(min_segment_query=6)).drop("anchors")


@query
def search_ranked(spark, d):
    """The vectors searched in the subjects: every chain with its rank, however weak, in small buckets."""
    subjects, _ = subjects_and_queries(spark, d)
    return search(subjects, vectors(spark, d), Settings(max_p=1.0, bucket=64)).drop("anchors")


@query
def search_thorough(spark, d):
    return search(*subjects_and_queries(spark, d), Settings(min_segment_query=6, fast_background=False, warp=2)).drop("anchors")


# streams


@query
def in_strand_items(spark, d):
    return items(spark, d, "m_reads").where("m_reads is not null").select("item_id", in_strand(F.transform("m_reads", lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))).cast("double"))).alias("in_strand"))


@query
def in_strand_average(spark, d):
    return states.average_in_bounds(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 40.0, 60.0)


@query
def in_strand_ranges(spark, d):
    return states.state_ranges(table(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "view", "event_id", F.max(F.col("event_id") + 1))


@query
def channel_parts(spark, d):
    rows = items(spark, d, "m_channel_num").withColumn("part", F.coalesce(channel_range("m_channel_num", 1, 512, 5), F.lit(-1)))
    return rows.groupBy("part").agg(F.count("*").alias("n"))


@query
def stream_decisions(spark, d):
    """The queue as a live stream, of the items whose id is divisible by 100: each searched in the subjects and decided on.

    The subjects are read once and written beside the stream, as every batch searches them. Files are steps, which a batch holds many of.
    """
    folder = new_folder(spark, "live")
    chunk = "item_id bigint, m_channel_num bigint, m_reads array<float>, queued_at timestamp_ntz"
    source = chunk_stream(spark, f"{d}/wqueue.parque[t]", chunk, bytes_per_batch=1 << 30).where("m_channel_num between 1 and 512 and item_id % 100 = 0")
    step = F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("step")
    chunks = source.select(step, "item_id", F.col("m_channel_num").alias("channel"), F.col("queued_at").alias("at"), F.col("m_reads").alias("samples"))
    subjects, _ = subjects_and_queries(spark, d)
    live(chunks, subjects, Settings(min_segment_query=6, max_p=0.05), folder).awaitTermination()
    out = checkpointed(read_decisions(spark, folder))
    remove_folder(spark, folder)
    return rounded(out.drop("batch"), "p_value", digits=9)


@query
def stream_channel_state(spark, d):
    """The running state of each channel after the whole queue went through the stream."""
    return stream_state(spark, d)


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "stream")
    chunk = "item_id bigint, m_channel_num bigint, m_reads array<float>, queued_at timestamp_ntz"
    # a glob, so that the table may be one file or a folder of them
    # the state does not depend on how the queue is cut into batches, and each batch costs a round of the state stores
    source = chunk_stream(spark, f"{d}/wqueue.parque[t]", chunk, bytes_per_batch=1 << 30).where("m_channel_num between 1 and 512")
    # the samples are folded where they are read: only states are shuffled, for the duplicates and for the channels
    chunks = chunk_states(source.select("item_id", F.col("m_channel_num").alias("channel"), F.col("m_reads").alias("samples")), "samples", 1e6)
    out = channel_states(chunks.dropDuplicates(["item_id"]), "channel")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    last = checkpointed(rows.groupBy("channel").agg(F.max(F.struct("n", "mean", "ssq")).alias("s")))
    remove_folder(spark, folder)
    return rounded(last.select("channel", "s.n", "s.mean", "s.ssq"), "mean", digits=4).withColumn("ssq", F.round(F.col("ssq") / F.greatest("n", F.lit(1)), 3))


SQL: dict[str, str] = oracle.SQL
