"""Long lists cut into overlapping pieces at natural boundaries, by packing their structure tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import broadcast_if_small, checkpointed, one_row_per_key

LIMIT, OVERLAP, GAP = 4096, 64, 10


def gap_ends(missing: np.ndarray, gap: int = GAP) -> np.ndarray:
    """First positions after stretches of `gap` or more missing samples that have a sample present on both sides."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], missing.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    return end[(end - begin >= gap) & (begin > 0) & (end < len(missing))]


Node = tuple[int, int, list]


def tree(n: int, marks: np.ndarray, gaps: np.ndarray) -> list[Node]:
    """The list's structure: sequences (between `marks`), each with its stretches (between `gaps`), as (start, end, children)."""
    top = np.concatenate([[0], marks, [n]])
    nodes = []
    for a, b in zip(top[:-1].tolist(), top[1:].tolist()):
        inner = gaps[np.searchsorted(gaps, a, "right") : np.searchsorted(gaps, b, "left")].tolist()
        cut = [a, *inner, b]
        nodes.append((a, b, [(x, y, []) for x, y in zip(cut, cut[1:])] if inner else []))
    return nodes


def starts(nodes: list[Node]) -> list[int]:
    """Where the nodes of a tree start, but for the list's own start: its natural boundaries, each once."""
    out: list[int] = []
    for a, _, children in nodes:
        out += [c for c, *_ in children] if children else [a]
    return out[1:] if out and not out[0] else out


def pack(nodes: list[Node], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Bottom-up: sibling subtrees are merged while they fit; only a node too large by itself is opened.

    Gives (start, end, whether the cut at end is natural) of the new samples of each piece; every piece but the list's first
    also repeats `overlap` samples, so it has room for `limit - overlap` new ones. What is left at the end of an opened node, or
    of a leaf cut at the limit, goes on to be merged with the siblings that follow.
    """
    room = lambda start: limit if start == 0 else limit - overlap
    out: list[tuple[int, int, bool]] = []
    held: list[int] = []  # the piece that still grows: start and end

    def close(natural: bool = True) -> None:
        if held:
            out.append((held[0], held[1], natural))
            held.clear()

    def take(a: int, b: int, children: list[Node]) -> None:
        if held and b - held[0] <= room(held[0]):
            held[1] = b
        elif b - a <= room(a):
            close()
            held[:] = a, b
        elif children:
            for child in children:
                take(*child)
        else:  # a leaf beyond the limit has no boundary in reach
            close()
            while b - a > room(a):
                out.append((a, a + room(a), False))
                a = out[-1][1]
            held[:] = a, b

    for node in nodes:
        take(*node)
    close()
    return out


def piece_ranges(n: int, marks: np.ndarray, gaps: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[tuple[int, int, bool]]]:
    """(natural boundaries, pieces with their overlap) of a list of n samples, both read off its tree."""
    nodes = tree(n, marks, np.setdiff1d(gaps, marks))
    return starts(nodes), [(max(0, s - overlap), e, natural) for s, e, natural in pack(nodes, limit, overlap)]


PARSED = "tab string, item_id bigint, n int, cuts array<int>"


def list_gaps(lists: DataFrame, gap: int = GAP) -> DataFrame:
    """(tab, item_id, n, gaps): length and ends of the long gaps of each list of (tab, item_id, samples), in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, off = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            gaps = [gap_ends(np.isnan(x[s:e]), gap) for s, e in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(off).astype(np.int32)), pa.array(gaps, pa.list_(pa.int32()))], ["tab", "item_id", "n", "gaps"])

    return lists.select("tab", "item_id", "samples").mapInArrow(run, "tab string, item_id bigint, n int, gaps array<int>")


def parsed(gaps: DataFrame, marks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tab, item_id, n, cuts) of lists given by length and gaps, and by the `marks` (tab, item_id, marks) inside them.

    cuts are the starts of the nodes of the list's tree, the first samples after marks and gaps; a place that is both counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = []
            for n, g, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                at, g = np.unique(np.asarray(m or [], np.int64)), np.asarray(g or [], np.int64)
                cuts.append(starts(tree(n, at, np.setdiff1d(g, at))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cuts, pa.list_(pa.int32()))], ["tab", "item_id", "n", "cuts"])

    rows = gaps.join(marks, ["tab", "item_id"], "left")
    return rows.select("tab", "item_id", "n", "gaps", "marks").mapInArrow(run, PARSED)


PIECES = "tab string, item_id bigint, piece int, start int, end int, natural boolean, samples array<float>"


def cut_up(lists: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP) -> DataFrame:
    """(tab, item_id, piece, start, end, natural, samples) of lists (tab, item_id, samples, marks), each parsed and sliced in place.

    Pieces are half-open ranges of at most `limit` samples, all but the first beginning `overlap` samples before the end of the
    piece before; they cover the list. A list of only missing samples is cut at the limit. No marks may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, off = b.column(2).values, b.column(2).offsets.to_numpy()
            x = values.to_numpy(zero_copy_only=False)
            for i, m in enumerate(b.column(3).to_pylist()):
                s, n = int(off[i]), int(off[i + 1] - off[i])
                _, got = piece_ranges(n, np.unique(np.asarray(m or [], np.int64)), gap_ends(np.isnan(x[s : s + n]), gap), limit, overlap)
                start, end, natural = zip(*got)
                size = np.array(end) - start
                taken = values.take(pa.array(np.repeat(np.array(start) + s - np.cumsum(size) + size, size) + np.arange(size.sum())))
                slices = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), taken)
                rep = pa.array([i] * len(got))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rep), b.column(1).take(rep), pa.array(range(len(got)), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(natural), slices], ["tab", "item_id", "piece", "start", "end", "natural", "samples"])

    return lists.select("tab", "item_id", "samples", "marks").mapInArrow(run, PIECES)


def long_lists(wqueue: DataFrame, cdtw: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(tab, item_id, samples) of both tables' lists beyond `limit`; null and short lists, and null ids, give no row."""
    queue = wqueue.where(F.size("m_reads") > limit).select(F.lit("wqueue").alias("tab"), "item_id", F.col("m_reads").alias("samples"))
    subjects = cdtw.where(F.size("sub") > limit).select(F.lit("cdtw").alias("tab"), F.col("subject_id").alias("item_id"), F.col("sub").alias("samples"))
    return queue.unionByName(subjects).where("item_id is not null")


def inner_marks(lengths: DataFrame, offsets: DataFrame) -> DataFrame:
    """(subject_id, marks): the distinct end_pos inside each subject, whose `lengths` are (subject_id, n); no more than it has samples."""
    ends = offsets.select("subject_id", "end_pos")
    inside = ends.join(lengths.withColumnsRenamed({"n": "__n"}), "subject_id").where("end_pos > 0 and end_pos < __n").select("subject_id", "end_pos").distinct()
    return inside.groupBy("subject_id").agg(F.collect_list("end_pos").alias("marks"), F.count("*").alias("__many"))


def parse_lists(wqueue: DataFrame, cdtw: DataFrame, offsets: DataFrame) -> DataFrame:
    """The structure of every list beyond the limit, each id once.

    The lists are read in place; what is shuffled is their gaps and the offsets.
    """
    gaps = checkpointed(list_gaps(long_lists(wqueue, cdtw)).dropDuplicates(["tab", "item_id"]))
    lengths = gaps.where("tab = 'cdtw'").select(F.col("item_id").alias("subject_id"), "n")
    marks = inner_marks(lengths, offsets).select(F.col("subject_id").alias("item_id"), "marks", F.lit("cdtw").alias("tab"))
    return parsed(gaps, marks)


def boundaries(wqueue: DataFrame, cdtw: DataFrame, offsets: DataFrame) -> DataFrame:
    """Problem 4's cases: (tab, item_id, cut_at), once for each natural boundary inside a list beyond the limit."""
    rows = parse_lists(wqueue, cdtw, offsets).select("tab", "item_id", F.explode("cuts").alias("cut_at"))
    return rows.withColumn("cut_at", F.col("cut_at").cast("bigint"))


def pieces(wqueue: DataFrame, cdtw: DataFrame, offsets: DataFrame) -> DataFrame:
    """(tab, item_id, piece, start, end, natural, samples): the pieces of every list beyond the limit, a repeated item once.

    The lists are cut up where they are read and never shuffled; only the marks of the subjects go to them, broadcast after
    they were counted. Beyond BROADCAST_ROWS of them, lists of subjects and marks meet in a shuffle.
    """
    queue = one_row_per_key(wqueue.where("item_id is not null").select("item_id", "m_reads"), "item_id")
    subjects = one_row_per_key(cdtw.where("subject_id is not null").select("subject_id", "sub"), "subject_id")
    marks = checkpointed(inner_marks(subjects.select("subject_id", F.size("sub").alias("n")).where(F.col("n") > LIMIT), offsets))
    many = marks.agg(F.sum("__many")).first()[0] or 0
    rows = long_lists(queue, subjects).where("tab = 'wqueue'").withColumn("marks", F.array().cast("array<bigint>"))
    own = long_lists(queue, subjects).where("tab = 'cdtw'").join(broadcast_if_small(marks.select(F.col("subject_id").alias("item_id"), "marks"), many), "item_id", "left")
    return cut_up(rows).unionByName(cut_up(own))


def covered(cut: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(tab, item_id, n, fits, joined) of pieces: new samples in all, whether none is over the limit, whether each begins `overlap` before the last one's end."""
    rows = cut.select("tab", "item_id", "piece", "start", "end", F.size("samples").alias("held"))
    before = F.lag("end").over(Window.partitionBy("tab", "item_id").orderBy("piece"))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    ok = (F.col("held") <= limit) & (F.col("held") == F.col("end") - F.col("start"))
    joins = F.col("start") == F.greatest(F.col("before") - overlap, F.lit(0))
    return rows.groupBy("tab", "item_id").agg(F.sum(F.col("end") - F.col("before")).alias("n"), F.bool_and(ok).alias("fits"), F.bool_and(joins).alias("joined"))
