"""Runs of consecutive items that repeat each other's signal, each collapsed into one event."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import broadcast_if_small, checkpointed

#: Largest difference of two readings that count as the same, largest drift of the alignment in samples, samples compared
#: at once, share of blocks that must agree, and largest share by which the lengths may differ.
TOLERANCE, DRIFT, BLOCK, AGREE, LENGTHS = 3.0, 12, 16, 0.85, 0.1


def repeats(x: np.ndarray, y: np.ndarray, tolerance: float = TOLERANCE, drift: int = DRIFT, block: int = BLOCK, agree: float = AGREE, lengths: float = LENGTHS) -> bool:
    """Whether `y` carries the signal of `x` with at most small alterations.

    Few samples may be added or lost anywhere, the level may move and noise may be added within `tolerance`, and missing
    samples agree with anything. Each block of `y` must match `x` at its own place under one shift of at most `drift`;
    signals that share only a part fail as the rest of their blocks don't match. Signals without finite samples repeat nothing.
    """
    n, m = len(x), len(y)
    if not n or not m or abs(n - m) > max(drift, lengths * max(n, m)):
        return False
    fx, fy = np.isfinite(x), np.isfinite(y)
    if not fx.any() or not fy.any():
        return False
    drift = min(max(drift, abs(n - m) + 2), max(n, m))
    pad = np.full(m + 2 * drift, np.nan, np.float32)
    k = min(n, m + drift)
    pad[drift : drift + k] = x[:k]
    block = min(block, m)
    count = m // block
    use = count * block
    best = np.zeros(count)
    yy = np.where(fy, y, np.nan)[:use].astype(np.float32)
    pad[~np.isfinite(pad)] = np.nan
    for s in sorted(range(2 * drift + 1), key=lambda s: abs(s - drift)):
        d = np.abs(pad[s : s + use] - yy)
        both = ~np.isnan(d)
        ok = ((d <= tolerance) & both).reshape(count, block).sum(1)
        of = both.reshape(count, block).sum(1)
        here = np.where(of >= block // 2, ok / np.maximum(of, 1), np.where(of > 0, ok / np.maximum(of, 1) * 0.5, 0))
        best = np.maximum(best, here)
        if s == drift and best.mean() >= 0.98:
            return True
    present = fy[:use].reshape(count, block).any(1)
    return bool(present.any() and (best[present] >= 0.9).mean() >= agree)


ROW = "item_id bigint, channel bigint, at timestamp, part int, place int, same boolean, content binary, first_signal array<float>, last_signal array<float>"


def content(x: np.ndarray) -> bytes:
    """128 bits that tell one signal from another; missing samples are alike."""
    return hashlib.md5(np.where(np.isnan(x), np.float32("nan"), x + np.float32(0)).astype(np.float32).tobytes(), usedforsecurity=False).digest()


def compared(queue: DataFrame) -> DataFrame:
    """(item_id, channel, at, part, place, same, content, ...): items in order, each with whether it repeats the item before it.

    The rows are range-partitioned by (channel, queued_at, item_id), so a hot channel spreads over many tasks; in a task
    neighbours are compared as they stream by, repeated rows of an item being neighbours too. The first item of a task
    has its signal kept, as has the last, and `same` null until `linked` compares them.
    """
    rows = queue.where("m_channel_num is not null and item_id is not null").select("item_id", F.col("m_channel_num").alias("channel"), F.col("queued_at").alias("at"), F.col("m_reads").alias("signal"))
    order = ["channel", "at", "item_id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        last: tuple | None = None
        held: list | None = None  # the row to be given next: it may turn out to be the last
        out: list[list] = []
        types = [pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32())]
        names = ["item_id", "channel", "at", "part", "place", "same", "content", "first_signal", "last_signal"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        for b in batches:
            items, channels, ats = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            values, off = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            ats = ats.to_pylist()
            for i, item in enumerate(items):
                if last is not None and last[0] == item:
                    continue
                x = values[off[i] : off[i + 1]]
                same = None if last is None else last[1] == channels[i] and repeats(last[2], x)
                if held is not None:
                    out.append(held)
                held = [item, channels[i], ats[i], part, place, same, content(x), x.copy() if last is None else None, None]
                last = (item, channels[i], x)
                place += 1
            last = last and (last[0], last[1], last[2].copy())
            if out:
                yield pack(out)
                out = []
        if held is not None:
            held[8] = last[2]
            yield pack([held])

    return rows.mapInArrow(run, ROW)


def linked(queue: DataFrame) -> DataFrame:
    """(item_id, channel, at, part, place, same, content): `compared`, with the edges of tasks compared too.

    The numbers of the tasks that have rows are put in order, one narrow row a task; the signals at the edges then meet by
    an equi-join on that number. Repeated rows of an item can't be spread over two tasks, as equal sort keys share a range.
    """
    rows = checkpointed(compared(queue))
    tasks = rows.groupBy("part").agg(F.max("channel").alias("to"))
    ordered = Window.orderBy("part")  # a number and a channel for each task
    before = tasks.select(F.col("part").alias("here"), F.lag("part").over(ordered).alias("part_before"), F.lag("to").over(ordered).alias("channel_before"))
    lasts = rows.where("last_signal is not null").select(F.col("part").alias("of"), "last_signal")
    firsts = rows.where("first_signal is not null").select("part", "channel", "first_signal").join(before, (F.col("part") == F.col("here")) & (F.col("channel") == F.col("channel_before")))
    pairs = firsts.join(lasts, F.col("part_before") == F.col("of")).select("part", "last_signal", "first_signal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [repeats(u.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)) for u, v in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * len(ok), pa.int32()), pa.array(ok, pa.bool_())], ["part", "place", "edge"])

    edge = checkpointed(pairs.mapInArrow(run, "part int, place int, edge boolean"))  # a row a task at most
    narrow = rows.select("item_id", "channel", "at", "part", "place", "same", "content")
    joined = narrow.join(broadcast_if_small(edge, edge.count()), ["part", "place"], "left")
    return joined.select("item_id", "channel", "at", "part", "place", F.coalesce("same", "edge", F.lit(False)).alias("same"), "content")


def canonical(rows: DataFrame) -> DataFrame:
    """`linked` rows with `event`, the canonical signal each item stands for, in place of same and content.

    An item that repeats the one before it stands for what that one stands for; any other for its own content. So equal
    signals of a channel are the same event wherever they come up. Should an item equal the head of the stretch just
    before it without repeating that stretch's last item, it is an event of its own, as it continues nothing.
    """
    head = F.when(~F.col("same"), F.struct("channel", "content", "item_id"))
    rows = _carried(rows.withColumn("head", head), "head", "head_before", strictly=True)
    again = (F.col("head_before.channel") == F.col("channel")) & (F.col("head_before.content") == F.col("content"))
    own = F.when(~F.col("same"), F.struct("content", F.when(again, F.col("item_id")).alias("apart")))
    return _carried(rows.withColumn("own", own), "own", "event").select("item_id", "channel", "at", "part", "place", "event")


def _carried(rows: DataFrame, value: str, out: str, strictly: bool = False) -> DataFrame:
    """Adds `out`: the last `value` that is not null up to each row, or strictly before it, over all tasks in order.

    A task whose first rows have none takes it from the nearest task before that has one: a row a task, put in order.
    """
    tasks = rows.groupBy("part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("place"))).alias("__last"))
    before = F.last("__last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    tasks = checkpointed(tasks.select("part", before.alias("__before")))
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    rows = rows.join(broadcast_if_small(tasks, tasks.count()), "part")
    return rows.withColumn(out, F.coalesce(F.last(value, True).over(upto), "__before")).drop("__before")


def runs(queue: DataFrame, least: int = 2) -> DataFrame:
    """Problem 2: (channel, first_item_id, last_item_id, items, began, ended, seconds) of each run of `least` or more items.

    Every item is given its canonical event (`canonical`), which comes up again whenever the channel carries that signal
    again. The row number within the channel less the row number within (channel, event) is constant along a run and
    differs between two runs of one event, so grouping by event and difference gives each run's count and duration. Row
    numbers are built from the sorted tasks' own counts, so no channel gathers in one task.
    Items of null channel or without samples take part in no run; a repeated item_id counts once; empty input: no rows.
    """
    rows = canonical(linked(queue))
    # row numbers: per task first, then the counts of the tasks before are added
    by_channel, by_event = Window.partitionBy("part", "channel").orderBy("place"), Window.partitionBy("part", "channel", "event").orderBy("place")
    rows = checkpointed(rows.withColumns({"__i": F.row_number().over(by_channel), "__j": F.row_number().over(by_event)}))
    earlier = numbers_before(rows, ["channel"], "__earlier")
    earlier_event = numbers_before(rows, ["channel", "event"], "__earlier_event")
    rows = rows.join(earlier, ["channel", "part"]).join(earlier_event, ["channel", "event", "part"])
    island = F.col("__i") + F.col("__earlier") - F.col("__j") - F.col("__earlier_event")
    key = F.struct("at", "item_id")
    out = rows.groupBy("channel", "event", island.alias("__island")).agg(F.min(key).alias("f"), F.max(key).alias("l"), F.count("*").alias("items")).where(F.col("items") >= least)
    seconds = (F.unix_micros("l.at") - F.unix_micros("f.at")) / 1e6
    return out.select("channel", F.col("f.item_id").alias("first_item_id"), F.col("l.item_id").alias("last_item_id"), "items", F.col("f.at").alias("began"), F.col("l.at").alias("ended"), seconds.alias("seconds"))


def numbers_before(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, part, out): rows of each group in the tasks before each of its tasks."""
    sizes = rows.groupBy(*keys, "part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, "part", F.coalesce(before, F.lit(0)).alias(out))
