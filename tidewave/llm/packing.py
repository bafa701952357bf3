"""Items of varying size packed into containers of fixed capacity, by rounds of bulk best fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.session import checkpointed

CAPACITY = 2048
#: Rows of one class that are numbered in one task; larger classes are numbered in parts.
PART = 1_000_000


def numbered(df: DataFrame, group: str, key: str, out: str, counts: dict[int, int]) -> DataFrame:
    """Adds `out`, the row's number from 0 within `group`; `counts`: rows of each group, `key`: unique.

    A group of more than PART rows is dealt by a hash of the key into parts of about that many, which are numbered by
    themselves, and the counts of the parts before are added; those are a row for each group and each PART rows.
    """
    row = F.row_number().over(Window.partitionBy(group, *(["__part"] if max(counts.values(), default=0) > PART else [])).orderBy(key)) - 1
    if max(counts.values(), default=0) <= PART:
        return df.withColumn(out, row.cast("long"))
    spark = df.sparkSession
    parts = spark.createDataFrame([(g, 1 + n // PART) for g, n in counts.items()], "__g int, __parts long")
    dealt = df.join(F.broadcast(parts), F.col(group) == F.col("__g")).withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts"))).drop("__g", "__parts")
    sizes = sorted((r[0], r[1], r[2]) for r in dealt.groupBy(group, "__part").count().collect())
    starts, of, before = [], None, 0
    for g, p, n in sizes:
        before = before if g == of else 0
        starts.append((g, p, before))
        of, before = g, before + n
    side = F.broadcast(spark.createDataFrame(starts, "__g int, __p long, __start long"))
    rows = dealt.withColumn("__row", row).join(side, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return rows.withColumn(out, F.col("__row") + F.col("__start")).drop("__part", "__row", "__g", "__p", "__start")


def counts_by(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Rows by the whole number in `column`, which is from 0 to `size`: all that is collected."""
    out = np.zeros(size + 1, np.int64)
    for v, n in df.groupBy(column).count().collect():
        out[v] = n
    return out


def depths(gaps: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth below the gaps of each class, depth above its items, items placed) from counts by class.

    From the largest class down, gaps are laid on a stack and items take from its top: the depth of the stack is the prefix
    count of gaps less that of items, never below 0. An item finds the smallest gap not yet taken that holds it, its
    successor, at its own depth; items beyond the bottom of the stack find none.
    """
    g, i = gaps[::-1], items[::-1]
    net = np.cumsum(g - i)
    after = net - np.minimum(np.minimum.accumulate(net), 0)
    below = np.concatenate([[0], after[:-1]])
    above = below + g
    return below[::-1], above[::-1], np.minimum(i, above)[::-1]


def swept(gaps: DataFrame, items: DataFrame, classes: DataFrame) -> DataFrame:
    """(container, gap, took_size, took_no): each gap (container, gap, rank) and the item (size, no) it takes in one sweep, if any.

    `classes` (value, below, above, lo, take), one row a size, has the prefix counts. Every gap and item gets its own depth, which
    settles by rank who of equal ones comes first, and at each depth gaps and items alternate: the item next to a gap takes it.
    The rows are partitioned by depth, so a hot size is spread over as many groups as it has items.
    """
    side = F.broadcast(classes)
    g = gaps.join(side, F.col("gap") == F.col("value")).select((F.col("below") + F.col("rank")).alias("depth"), "value", F.lit(0).alias("kind"), "container", F.lit(None).cast("long").alias("no"))
    i = items.join(side, F.col("size") == F.col("value")).where((F.col("no") >= F.col("lo")) & (F.col("no") < F.col("lo") + F.col("take")))
    i = i.select((F.col("above") - 1 - F.col("no") + F.col("lo")).alias("depth"), "value", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("container"), "no")
    order = Window.partitionBy("depth").orderBy(F.col("value").desc(), "kind")
    both = g.unionByName(i).withColumns({"took_size": F.lead("value").over(order), "took_no": F.lead("no").over(order)})
    took = F.col("took_no").isNotNull()
    return both.where("kind = 0").select("container", F.col("value").alias("gap"), F.when(took, F.col("took_size")).alias("took_size"), "took_no")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, size, container): every item of positive `size` in exactly one container, none over `capacity`.

    Only an item beyond the capacity is split: into full pieces, each a container of its own, and the rest, which is
    packed like an item. Then rounds, until nothing is left: items and gaps are sorted into classes (sizes are whole numbers,
    so there are at most `capacity` of either); where the gaps can't hold what is left, as many containers as that needs are
    opened by the largest items, and in the first round by every item beyond half the capacity; then one sweep gives items
    their successors among the gaps (`swept`), gaps shrink by what they took and the next round begins. Containers that
    are too full for the smallest item left are set aside. Only counts per class reach the driver; items and gaps are matched
    and kept in Spark, each round's in the checkpoint folder.

    Null, zero and negative sizes give no row; repeated keys are items of their own; empty input gives no rows.
    """
    spark: SparkSession = sizes.sparkSession
    rows = sizes.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("total")).where("total > 0")
    rows = checkpointed(rows.withColumn("item", F.monotonically_increasing_id()))
    whole = rows.where(f"total >= {capacity}").select("key", "item", F.explode(F.sequence(F.lit(0), F.expr(f"cast(total div {capacity} as int) - 1"))).alias("piece"))
    full = whole.select("key", "piece", (F.col("piece") * capacity).cast("bigint").alias("start"), F.lit(capacity).cast("int").alias("size"), F.concat_ws(":", F.lit("full"), "item", "piece").alias("container"))
    rest = rows.where(f"total % {capacity} > 0").select("key", "item", F.expr(f"cast(total div {capacity} as int)").alias("piece"), F.expr(f"total div {capacity} * {capacity}").alias("start"), F.expr(f"cast(total % {capacity} as int)").alias("size"))
    left = counts_by(rest, "size", capacity)
    rest = checkpointed(numbered(rest, "size", "item", "no", {s: int(n) for s, n in enumerate(left) if n}))
    lo = np.zeros(capacity + 1, np.int64)
    classes = np.arange(capacity + 1)
    gaps = spark.createDataFrame([], "container long, gap int")
    held = np.zeros(capacity + 1, np.int64)
    placed: list[DataFrame] = []
    first = stuck = True
    while left.any():
        needed = int((classes * left).sum()) - (0 if stuck else int((classes * held).sum()))
        many = max(-(-needed // capacity), int(left[capacity // 2 + 1 :].sum()) if first else 0, 1 if stuck else 0)
        if many > 0:
            before = np.cumsum(left[::-1])[::-1] - left
            opens = np.clip(many - before, 0, left)
            table = spark.createDataFrame([(int(s), int(lo[s]), int(opens[s])) for s in np.flatnonzero(opens)], "value int, lo long, take long")
            began = rest.join(F.broadcast(table), F.col("size") == F.col("value")).where((F.col("no") >= F.col("lo")) & (F.col("no") < F.col("lo") + F.col("take")))
            placed.append(began.select("size", "no", F.col("item").alias("container")))
            gaps = gaps.unionByName(began.select(F.col("item").alias("container"), (F.lit(capacity) - F.col("size")).alias("gap")))
            lo, left = lo + opens, left - opens
            held = held + opens[::-1]  # an item of a size leaves a gap of the capacity less the size
            first = False
        if not left.any():
            break
        held[: int(np.flatnonzero(left)[0])] = 0
        gaps = gaps.where(F.col("gap") >= int(np.flatnonzero(left)[0]))
        below, above, take = depths(held, left)
        stuck = not take.any()
        if stuck:
            continue
        used = np.flatnonzero((held > 0) | (take > 0))
        table = spark.createDataFrame([(int(v), int(below[v]), int(above[v]), int(lo[v]), int(take[v])) for v in used], "value int, below long, above long, lo long, take long")
        ranked = numbered(gaps, "gap", "container", "rank", {int(v): int(held[v]) for v in np.flatnonzero(held)})
        state = checkpointed(swept(ranked, rest, table))
        placed.append(state.where("took_no is not null").select(F.col("took_size").alias("size"), F.col("took_no").alias("no"), "container"))
        lo, left = lo + take, left - take
        gaps = state.select("container", (F.col("gap") - F.coalesce("took_size", F.lit(0))).alias("gap")).where("gap > 0")
        held = counts_by(gaps, "gap", capacity)
    out = full
    if placed:
        every = placed[0]
        for p in placed[1:]:
            every = every.unionByName(p)
        shared = rest.select("key", "piece", "start", "size", "no").join(every, ["size", "no"])
        out = out.unionByName(shared.select("key", "piece", "start", "size", F.concat_ws(":", F.lit("shared"), "container").alias("container")))
    return out.withColumnRenamed("key", key)
