"""How much of each sequence is needed to tell it from all others."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import broadcast_if_small, checkpointed


def unique_prefixes(seqs: DataFrame, key: str, seq: str, extra: int = 3) -> DataFrame:
    """(key, prefix_len, kept_len, suffix_len): the longest prefix shared with any other sequence, and what to keep.

    In order of text the longest shared prefix is with a neighbour, so the rows are range-partitioned by text and each task
    compares neighbours; the last text of each task meets the first of the next in a table of one row per task. kept_len is
    prefix_len + extra, at most the length. Equal sequences share all of it; null sequences give no row; an only sequence
    shares nothing.
    """
    kind = seqs.schema[key].dataType.simpleString()
    rows = seqs.select(F.col(key).alias("key"), F.col(seq).alias("seq")).where("seq is not null").repartitionByRange("seq", "key").sortWithinPartitions("seq", "key")
    names = ["key", "len", "best", "part", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # held: the last row so far, whose next neighbour is not yet seen
        types = [k, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        for b in batches:
            out = []
            for key_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = [key_, len(text), 0, part, text if held is None else None, text]
                if held is not None:
                    row[2] = shared = len(commonprefix([held[5], text]))
                    out.append([*held[:2], max(held[2], shared), *held[3:5], None])
                held = row
            if out:
                yield pack(out)
        if held is not None:
            yield pack([held])

    k = pa.string() if kind == "string" else pa.int64()
    found = checkpointed(rows.mapInArrow(run, f"key {kind}, len int, best int, part int, first string, last string"))
    # the numbers of the tasks are put in order, a narrow row each; the texts at their edges then meet by an equi-join
    w = Window.orderBy("part")
    order = found.select("part").distinct().select(F.col("part").alias("here"), F.lead("part").over(w).alias("next"))
    ends = found.where("last is not null").select(F.col("part").alias("up_part"), "last").join(order, F.col("up_part") == F.col("here"))
    begins = found.where("first is not null").select(F.col("part").alias("down_part"), "first")
    pairs = ends.join(begins, F.col("next") == F.col("down_part")).select("up_part", "down_part", "last", "first")

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = [len(commonprefix([x, y])) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32())], ["up_part", "down_part", "shared"])

    edges = checkpointed(pairs.mapInArrow(edge, "up_part int, down_part int, shared int"))
    many = edges.count()
    up = broadcast_if_small(edges.select(F.col("down_part").alias("part"), F.col("shared").alias("up")), many)
    down = broadcast_if_small(edges.select(F.col("up_part").alias("part"), F.col("shared").alias("down")), many)
    zero = F.lit(0)
    narrow = found.select("key", "len", "best", "part", F.col("first").isNotNull().alias("first"), F.col("last").isNotNull().alias("last"))
    out = narrow.join(up, "part", "left").join(down, "part", "left")
    prefix = F.greatest("best", F.when(F.col("first"), F.coalesce("up", zero)).otherwise(zero), F.when(F.col("last"), F.coalesce("down", zero)).otherwise(zero))
    return out.select(F.col("key").alias(key), prefix.alias("prefix_len"), F.least(prefix + extra, F.col("len")).alias("kept_len"), (F.col("len") - prefix).alias("suffix_len"))
