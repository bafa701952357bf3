"""Mergeable rank-interval summaries of numeric values, and percentiles read from them with a certified rank error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.session import spread

#: Rank error allowed in all, as a share of the count, and the levels of merging over which it is spent in equal steps. A summary of
#: level l may be off by (l + 1) steps; beyond the last level nothing more is given away.
ERROR, LEVELS = 0.008, 8
#: Certified error beyond which no percentile is read.
ERROR_MOST = 0.01
#: Summaries that are merged at a time.
FAN_IN = 16
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
#: Values a task gathers before it summarises them, and keys it holds open before it gives their summaries away.
BUFFER, OPEN_KEYS = 65_536, 4_000

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # count, values, upper bound of values below, lower bound of values up to


def permitted(level: int) -> float:
    """Rank error that a summary of a level may have."""
    return ERROR * min(level + 1, LEVELS) / LEVELS


def summarise(x: np.ndarray, level: int = 0) -> Summary:
    """The exact summary of finite values, compressed."""
    v, c = np.unique(x, return_counts=True)
    upto = np.cumsum(c)
    return compress((len(x), v.astype(np.float64), upto - c, upto), permitted(level))


def merge(parts: list[Summary]) -> Summary:
    """One summary of all values behind `parts`; rank uncertainties add up, never more."""
    parts = [p for p in parts if p[0]]
    if not parts:
        return 0, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = np.unique(np.concatenate([p[1] for p in parts]))
    below, upto = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for n, pv, pb, pu in parts:
        below += np.concatenate([pb, [n]])[np.searchsorted(pv, v, "left")]
        upto += np.concatenate([[0], pu])[np.searchsorted(pv, v, "right")]
    return sum(p[0] for p in parts), v, below, upto


def compress(s: Summary, error: float) -> Summary:
    """Leaves out tuples as long as every rank between two that stay is certain within `error` of the count.

    From each tuple that stays the farthest one is kept that the permission reaches; both ends stay.
    """
    n, v, below, upto = s
    reach = np.searchsorted(below, upto + 2 * error * n, "right") - 1
    keep, at, last = [0], 0, len(v) - 1
    while at < last:
        at = min(max(int(reach[at]), at + 1), last)
        keep.append(at)
    return (n, v[keep], below[keep], upto[keep]) if len(v) else s


class Ladder:
    """Summaries of one key by level: as soon as FAN_IN of a level are held they become one of the next."""

    def __init__(self) -> None:
        self.levels: list[list[Summary]] = []

    def add(self, s: Summary, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(s)
        if len(self.levels[level]) == FAN_IN:
            parts, self.levels[level] = self.levels[level], []
            self.add(compress(merge(parts), permitted(level + 1)), level + 1)

    def one(self) -> tuple[int, Summary]:
        """(level, summary) of all that was added."""
        parts = [s for held in self.levels for s in held]
        top = max((i for i, held in enumerate(self.levels) if held), default=0)
        return (top, parts[0]) if len(parts) == 1 else (top + 1, compress(merge(parts), permitted(top + 1)))


def rank_error(s: Summary) -> float:
    """Largest distance of any rank from the certain rank range of the tuple that answers it, as a share of the count."""
    n, v, below, upto = s
    if not n:
        return 0.0
    between = np.maximum(0, below[1:] - upto[:-1]) / 2
    return float(max(between.max(initial=0), np.maximum(0, below - upto).max(initial=0)) / n)


def quantile(s: Summary, q: np.ndarray) -> np.ndarray:
    """Values whose certain rank range is nearest to the ranks ceil(q * count)."""
    n, v, below, upto = s
    if not n:
        return np.full(len(q), np.nan)
    r = np.maximum(1, np.ceil(np.asarray(q) * n - 1e-9))
    j = np.minimum(np.searchsorted(upto, r), len(v) - 1)
    i = np.maximum(j - 1, 0)
    off = lambda k: np.maximum(np.maximum(below[k] + 1 - r, r - upto[k]), 0)
    return v[np.where(off(i) < off(j), i, j)]


LISTS = ("v", "below", "upto")
ARROW = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
NAMES = ("level", "n", "rank_error", *LISTS)
FIELDS = "level int, n bigint, rank_error double, v array<double>, below array<bigint>, upto array<bigint>"


def _row(level: int, s: Summary) -> tuple:
    return level, s[0], rank_error(s), s[1], s[2], s[3]


def _read(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Summary]]:
    """(level, summary) of each row."""
    lists = [t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c) for c in LISTS]
    off = lists[0].offsets.to_numpy()
    v, below, upto = (x.values.to_numpy(zero_copy_only=False) for x in lists)
    for level, n, a, b in zip(t.column("level").to_pylist(), t.column("n").to_pylist(), off, off[1:]):
        yield level, (n, v[a:b], below[a:b], upto[a:b])


def summaries(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, level, n, rank_error, v, below, upto): one summary of the finite numbers in the lists `values` for each group of `keys`.

    Every task summarises the lists it scans by key (map side, bounded buffers, merged by level), so only summaries are
    shuffled. Those of a key are merged in rounds, tasks with their neighbours first, so that however hot a key is no group
    has more than FAN_IN summaries for each time that a task ran out of open keys. Missing, NaN and infinite numbers
    and null lists do not count; a group without a finite number has no row; null keys form groups of their own.
    """
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    schema = "__part int, " + ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", " + FIELDS

    def emit(held: dict[tuple, Ladder], types: list[pa.DataType]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        c = list(zip(*((part, *k, *_row(*h.one())) for k, h in held.items())))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.int32(), *types, *ARROW])], ["__part", *keys, *NAMES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[tuple, list[np.ndarray]] = {}
        sizes: dict[tuple, int] = {}
        held: dict[tuple, Ladder] = {}
        types: list[pa.DataType] = []

        def fold(k: tuple) -> None:
            held.setdefault(k, Ladder()).add(summarise(np.concatenate(buffers.pop(k))))
            sizes.pop(k)

        for b in batches:
            types = [b.column(i).type for i in range(len(keys))]
            ks = list(zip(*(b.column(i).to_pylist() for i in range(len(keys)))))
            lists = b.column(len(keys))
            x, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, k in enumerate(ks):
                y = x[off[i] : off[i + 1]]
                y = y[np.isfinite(y)]
                if len(y):
                    buffers.setdefault(k, []).append(y)
                    sizes[k] = sizes.get(k, 0) + len(y)
                    if sizes[k] > BUFFER:
                        fold(k)
            if len(buffers.keys() | held.keys()) > OPEN_KEYS or sum(sizes.values()) > 64 * BUFFER:
                for k in list(buffers):
                    fold(k)
            if len(held) > OPEN_KEYS:
                yield emit(held, types)
                held = {}
        for k in list(buffers):
            fold(k)
        if held:
            yield emit(held, types)

    read = spread(df.where(F.size(values) > 0).select(*keys, values))
    tasks = read.rdd.getNumPartitions()
    out = read.mapInArrow(scan, schema)
    while tasks > FAN_IN:
        out = _joined(out.withColumn("__part", F.floor(F.col("__part") / FAN_IN).cast("int")), ["__part", *keys])
        tasks = -(-tasks // FAN_IN)
    return _joined(out, keys)


def _joined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, summary): the summaries of each group of `keys` merged into one; an only one stays as it is."""
    schema = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys) + ", " + FIELDS

    def join(t: pa.Table) -> pa.Table:
        ladder = Ladder()
        for level, s in sorted(_read(t), key=lambda x: x[0]):
            ladder.add(s, level)
        own = [pa.array([t.column(k)[0].as_py()], t.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*own, *(pa.array([x], f) for x, f in zip(_row(*ladder.one()), ARROW))], [*keys, *NAMES])

    return parts.select(*keys, *NAMES).groupBy(*keys).applyInArrow(join, schema)


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of the coarser groups `keys` from any summaries made here, such as of a channel from its days.

    The summaries of a key are counted, dealt by a hash into groups of about FAN_IN and merged, until one group is left. `parts`
    should be a written table, as it is read for the count and for the merging.
    """
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    out, number = parts.withColumn("__part", F.xxhash64("n", "v")), most
    while number > FAN_IN:
        number = -(-number // FAN_IN)
        out = _joined(out.withColumn("__part", F.pmod(F.col("__part"), F.lit(number))), ["__part", *keys])
    return _joined(out, keys)


def percentiles(sums: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(keys, n, rank_error, percent, value) read from summaries; one whose certified error is above ERROR_MOST is an error."""
    schema = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, rank_error double, percent int, value double"
    q = np.array(percents) / 100

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [s for _, s in _read(b)]
            if (b.column("rank_error").to_numpy() > ERROR_MOST).any():
                raise ValueError(f"a summary is certain only within more than {ERROR_MOST} of its count")
            values = np.concatenate([quantile(s, q) for s in got]) if got else np.zeros(0)
            again = pa.array(np.repeat(np.arange(len(got)), len(q)))
            own = [b.column(k).take(again) for k in (*keys, "n", "rank_error")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(percents, len(got)), pa.int32()), pa.array(values)], [*keys, "n", "rank_error", "percent", "value"])

    return sums.select(*keys, *NAMES).mapInArrow(read, schema)
