"""Implausible readings: out of range, far outside a channel's normal signal, or stuck, each channel by its own standard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.session import checkpointed, one_row_per_key, spread

#: Channels the device has.
CHANNELS = (1, 512)
#: Steps of the device's widest range in which residuals are counted.
STEPS = 8192
#: Probability with which a normal reading may lie beyond a cutoff; shares of readings tried as tails, ever farther out; consecutive
#: readings that give one peak; peaks for which the device's typical tail counts beside a channel's own.
RISK, TAILS, BLOCK, BORROWED = 1e-9, (0.1, 0.05, 0.025), 32, 10.0
#: Change of the shape from one threshold to the next up to which it is stable, its greatest value, and the peaks at which it counts half.
STABLE, SHAPE_MOST, SHAPE_PEAKS = 0.05, 0.1, 500.0
#: Items at which an hour's own level weighs as much as the channel's.
OWN_ITEMS = 8
#: Largest movement of a resting signal, in readings; the share of rests in their tail, and the risk of a longest normal rest.
REST, REST_TAIL, STUCK_RISK = 1.0, 0.025, 1e-9
#: Rests longer than this are counted as this long.
REST_MOST = 4096
#: Samples worked on at once.
AT_ONCE = 1 << 20


def rests(x: np.ndarray, item: np.ndarray | None = None, move: float = REST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, present readings) of the stretches whose present readings stay within two neighbouring steps of size `move`.

    Readings are binned two steps wide, once from even and once from odd steps, so every pair of neighbouring steps is a bin
    of one of them; runs of one bin are the rests. Missing samples neither end a rest nor begin or end it; readings that
    are not finite rest nowhere. `item` numbers the lists that x joins: no rest runs over the edge of two.
    """
    at = np.flatnonzero(~np.isnan(x))
    y = np.floor(x[at].astype(np.float64) / move)
    edge_of = np.zeros(max(0, len(at) - 1), bool) if item is None else np.diff(item[at]) != 0
    begins, ends, present = [], [], []
    for shift in (0, 1):
        label = np.floor((y + shift) / 2)
        new = np.ones(len(y) + 1, bool)
        with np.errstate(invalid="ignore"):
            new[1:-1] = ~(np.diff(label) == 0) | edge_of
        edge = np.flatnonzero(new)
        long = np.diff(edge) >= 2
        begins.append(at[edge[:-1][long]])
        ends.append(at[edge[1:][long] - 1] + 1)
        present.append(np.diff(edge)[long])
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(present)


def stuck_samples(x: np.ndarray, longest: float) -> np.ndarray:
    """Whether each reading belongs to a rest of at least `longest` samples.

    Where all but the ends of a rest is one value, differing readings at its ends are the signal coming to rest, not it.
    """
    stuck = np.zeros(len(x), bool)
    for a, b, n in zip(*rests(x)):
        if n >= longest:
            y = x[a:b]
            core = y[3:-3][~np.isnan(y[3:-3])]
            if len(core) and core.min() == core.max():
                same = np.flatnonzero(y == core[0])
                a, b = a + same[0], a + same[-1] + 1
            stuck[a:b] |= ~np.isnan(x[a:b])
    return stuck


def portions(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold about AT_ONCE samples each, a longer list alone."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + AT_ONCE, "right")) - 1)
        yield a, b
        a = b


def levels(items: DataFrame) -> DataFrame:
    """(channel, hour, items, level): the channel's usual level at each hour of the day, drawn to its level over all hours.

    A level is the median of item medians, so neither spikes nor long items sway it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            x, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            mid = []
            for i in range(len(lists)):
                y = x[off[i] : off[i + 1]]
                y = y[np.isfinite(y)]
                mid.append(float(np.median(y)) if len(y) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(mid, pa.float64())], ["channel", "hour", "middle"])

    # a narrow row an item, read twice
    mids = checkpointed(items.select("channel", "hour", "samples").mapInArrow(run, "channel bigint, hour int, middle double").where("middle is not null"))
    whole = mids.groupBy("channel").agg(F.percentile_approx("middle", 0.5, 1000).alias("whole"), F.count("*").alias("items"))
    hours = mids.groupBy("channel", "hour").agg(F.percentile_approx("middle", 0.5, 1000).alias("own"), F.count("*").alias("n"))
    weight = F.col("n") / (F.col("n") + OWN_ITEMS)
    return hours.join(whole, "channel").select("channel", "hour", "items", (weight * F.col("own") + (1 - weight) * F.col("whole")).alias("level"))


def tallies(items: DataFrame) -> DataFrame:
    """(channel, what, at, n): counts of residuals ('r'), of their peaks up ('u') and down ('l'), and of rests by length ('s').

    Residuals are in steps; only readings within the channel's range count. A peak is the farthest of BLOCK consecutive
    readings, so that a long excursion counts once and not with each of its readings. Every batch gives sums of its own, which
    are added map-side, so a hot channel shuffles no more than its distinct residuals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            channel, level, low, high, step = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            values, off = b.column(5).values.to_numpy(zero_copy_only=False), b.column(5).offsets.to_numpy()
            for i, j in portions(off):
                size = np.diff(off[i : j + 1])
                row = np.repeat(np.arange(i, j), size)
                x = values[off[i] : off[j]].astype(np.float64)
                with np.errstate(invalid="ignore"):
                    x[~((x > low[row]) & (x < high[row]))] = np.nan
                begin, _, rest = rests(x, row)
                ok = ~np.isnan(x)
                r = np.clip(np.round((x - level[row]) / step[row]), -STEPS, STEPS)
                blocks = -(-size // BLOCK)
                first = np.repeat(off[i:j] - off[i] - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())
                up, down = np.fmax.reduceat(r, first), np.fmin.reduceat(r, first)
                owner, there = channel[np.repeat(np.arange(i, j), blocks)], ~np.isnan(up)
                counts = (("r", channel[row[ok]], r[ok]), ("u", owner[there], up[there]), ("l", owner[there], down[there]), ("s", channel[row[begin]], np.minimum(rest, REST_MOST)))
                for what, of, at in counts:
                    if len(at):
                        key, n = np.unique(of.astype(np.int64) << 32 | at.astype(np.int64) + STEPS, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array([what] * len(key)), pa.array(((key & 0xFFFFFFFF) - STEPS).astype(np.int32)), pa.array(n)], ["channel", "what", "at", "n"])

    counted = items.select("channel", "level", "low", "high", "step", "samples").mapInArrow(run, "channel bigint, what string, at int, n bigint")
    return counted.groupBy("channel", "what", "at").agg(F.sum("n").alias("n"))


def weighted_quantile(at: np.ndarray, n: np.ndarray, q: float) -> float:
    """Value below which a share q of counted values lies; `at` ascends."""
    return float(at[min(len(at) - 1, np.searchsorted(np.cumsum(n), q * n.sum()))])


def l_moments(excess: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(count, mean, second L-moment) of counted excesses, ascending: probability-weighted moments of the sample."""
    many = n.sum()
    if not many:
        return 0.0, 0.0, 0.0
    mean = float((excess * n).sum() / many)
    before = np.cumsum(n) - n
    weighted = float((excess * (n * before + n * (n - 1) / 2)).sum() / max(many * (many - 1), 1.0))
    return float(many), mean, 2 * weighted - mean if many > 1 else mean / 2


def stable_shape(shapes: list[float], peaks: float) -> float:
    """Shape of the tail from those fitted at rising thresholds: the last if it agrees with the one before.

    A shape that still moves says nothing of where the tail ends: it is at least 0 then, the limit of all tails that thin
    out faster than any power. Few peaks draw it to 0.
    """
    shape = shapes[-1] if abs(shapes[-1] - shapes[-2]) <= STABLE else max(shapes[-1], 0.0)
    return float(min(shape * peaks / (peaks + SHAPE_PEAKS), SHAPE_MOST))


def tail_reach(mean: float, shape: float, share: float) -> float:
    """Distance beyond its threshold that a generalised Pareto tail exceeds with probability RISK a reading.

    mean: of the excesses; share: peaks a reading.
    """
    far = float(np.log(max(share, RISK) / RISK))
    scale = mean * (1 - shape)
    return scale * far if abs(shape) < 1e-6 else float(scale / shape * np.expm1(shape * far))


SIDES = {"u": 1.0, "l": -1.0}


def tallied(table: pd.DataFrame, what: str, sign: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(values ascending, counts) of one kind of tally."""
    t = table[table["what"] == what]
    at, n = sign * t["at"].to_numpy(float), t["n"].to_numpy(float)
    by = np.argsort(at)
    return at[by], n[by]


def usual_bounds(at: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Generous bounds of the normal residuals, from their middle and deciles only."""
    mid = weighted_quantile(at, n, 0.5)
    wide = max(weighted_quantile(at, n, 0.9) - mid, mid - weighted_quantile(at, n, 0.1), 1.0)
    return mid - 3 * wide, mid + 3 * wide


def side_tail(table: pd.DataFrame, side: str, tail: float, low: float, high: float) -> tuple[float, float, float, float, float]:
    """(threshold, peaks beyond it, their mean excess, second L-moment, readings) of one side, upward, within the bounds."""
    sign = SIDES[side]
    low, high = (low, high) if sign > 0 else (-high, -low)
    at, n = tallied(table, "r", sign)
    at, n = at[(at >= low) & (at <= high)], n[(at >= low) & (at <= high)]
    if not n.sum():
        return 0.0, 0.0, 0.0, 0.0, 0.0
    u = weighted_quantile(at, n, 1 - tail)
    peak, k = tallied(table, side, sign)
    out = (peak > u) & (peak <= high)
    return u, *l_moments(peak[out] - u, k[out]), float(n.sum())


def rest_tail(table: pd.DataFrame, bound: float) -> tuple[float, float, float, float]:
    """(threshold, rests longer than it, their mean excess less one, rests) among those no longer than `bound`."""
    length, n = tallied(table, "s")
    length, n = length[length <= bound], n[length <= bound]
    if not n.sum():
        return 2.0, 0.0, 0.0, 0.0
    u = weighted_quantile(length, n, 1 - REST_TAIL)
    out = length > u
    return u, float(n[out].sum()), float(((length[out] - u - 1) * n[out]).sum() / max(n[out].sum(), 1.0)), float(n.sum())


def rest_reach(mean: float, share: float) -> float:
    """Further samples that a rest beyond the threshold, its lengths being geometric, gets at STUCK_RISK a rest."""
    again = min(max(mean / (1 + mean), 1e-6), 1 - 1e-6)
    return float(np.log(max(share, STUCK_RISK) / STUCK_RISK) / -np.log(again))


def measured(tally: DataFrame) -> DataFrame:
    """(channel, what, tail, n, mean, second, spread): each channel's tails at every threshold tried; of its rests, mean is the share of those beyond the threshold that go on."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        c, rows = int(t["channel"].iloc[0]), []
        at, n = tallied(t, "r")
        if n.sum():
            low, high = usual_bounds(at, n)
            inside = (at >= low) & (at <= high)
            spread = max(weighted_quantile(at[inside], n[inside], 0.99) - weighted_quantile(at[inside], n[inside], 0.01), 1.0)
            for side in SIDES:
                rows += [(c, side, tail, *side_tail(t, side, tail, low, high)[1:4], spread) for tail in TAILS]
        u, many, _, _ = rest_tail(t, np.inf)
        length, n = tallied(t, "s")
        going_on = n[length > u + 1].sum() / max(many, 1.0)  # a few stuck ones don't sway it as they would a mean
        return pd.DataFrame([*rows, (c, "s", 0.0, many, going_on, 0.0, 1.0)], columns=["channel", "what", "tail", "n", "mean", "second", "spread"])

    return tally.groupBy("channel").applyInPandas(run, "channel bigint, what string, tail double, n double, mean double, second double, spread double")


def typical(tails: DataFrame) -> dict[str, tuple[float, float]]:
    """What -> (shape, mean excess as a share of the spread) over all channels together; a row for each threshold is all that is collected."""
    n = F.col("n")
    rows = tails.where("n > 0").groupBy("what", "tail").agg(F.sum("n").alias("n"), (F.sum(n * F.col("second") / F.when(F.col("mean") > 0, F.col("mean"))) / F.sum(n)).alias("ratio"), (F.sum(n * F.col("mean") / F.col("spread")) / F.sum(n)).alias("mean")).collect()
    by = {(r["what"], r["tail"]): r for r in rows}
    going_on = min(by["s", 0.0]["mean"], 0.9) if ("s", 0.0) in by else 0.5
    out = {"s": (0.0, going_on / (1 - going_on))}
    for side in SIDES:
        got = [by[side, t] for t in TAILS if (side, t) in by and by[side, t]["ratio"]]
        if len(got) == len(TAILS):
            # of a generalised Pareto tail the ratio of the first two L-moments is 1 / (2 - shape)
            out[side] = stable_shape([2 - 1 / r["ratio"] for r in got], got[-1]["n"]), got[-1]["mean"]
        else:
            out[side] = 0.0, 0.1
    return out


def fit(table: pd.DataFrame, device: dict[str, tuple[float, float]]) -> tuple[float, float, float]:
    """(lower cutoff, upper cutoff, longest rest) of one channel's tallies, cutoffs as residuals in steps.

    The peaks over the farthest threshold of TAILS get a generalised Pareto tail: its shape is the device's, its mean excess
    the channel's own with the device's typical one beside it for BORROWED peaks. What lies beyond the cutoffs is taken
    out and the fit repeated until it holds, so that spikes don't widen it. Rests likewise, with geometric lengths.
    """
    at, n = tallied(table, "r")
    low, high = -np.inf, np.inf
    if n.sum():
        low, high = usual_bounds(at, n)
        for _ in range(4):
            inside = (at >= low) & (at <= high)
            a, k = at[inside], n[inside]
            spread = max(weighted_quantile(a, k, 0.99) - weighted_quantile(a, k, 0.01), 1.0)
            ends = {}
            for side in SIDES:
                u, peaks, mean, _, readings = side_tail(table, side, TAILS[-1], low, high)
                shape, usual = device[side]
                mean = (peaks * mean + BORROWED * usual * spread) / (peaks + BORROWED)
                ends[side] = u + max(tail_reach(mean, shape, max(peaks, 1.0) / readings), 1.0)
            was = (low, high)
            low, high = -ends["l"], ends["u"]
            if (low, high) == was:
                break
    usual = device["s"][1]
    longest = rest_tail(table, np.inf)[0] + 1 + np.ceil(rest_reach(usual, REST_TAIL))
    for _ in range(4):
        u, many, mean, of = rest_tail(table, longest)
        mean = (many * mean + BORROWED * usual) / (many + BORROWED)
        was, longest = longest, u + 1 + np.ceil(rest_reach(mean, max(many, 1.0) / max(of, 1.0)))
        if longest == was:
            break
    return low, high, float(longest)


def cutoffs(tally: DataFrame) -> DataFrame:
    """(channel, lower, upper, longest): every channel's standard, a row for each of the device's channels at most."""
    device = typical(measured(tally))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(t["channel"].iloc[0]), *fit(t, device))], columns=["channel", "lower", "upper", "longest"])

    return tally.groupBy("channel").applyInPandas(run, "channel bigint, lower double, upper double, longest double")


def stretches(items: DataFrame) -> DataFrame:
    """(item_id, first_sample, samples, kind) of each unbroken stretch of bad readings; kind joins the rules that met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            level, low, high, step, lower, upper, longest = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8))
            values, off = b.column(8).values.to_numpy(zero_copy_only=False), b.column(8).offsets.to_numpy()
            least, most = level + lower * step, level + upper * step
            out: list[tuple[int, int, int, str]] = []
            for i, j in portions(off):
                x = values[off[i] : off[j]]
                row = np.repeat(np.arange(i, j), np.diff(off[i : j + 1]))
                with np.errstate(invalid="ignore"):
                    odd = np.isinf(x) | (x <= low[row]) | (x >= high[row])
                    far = (x < least[row]) | (x > most[row])
                begin, _, rest = rests(x, row)
                some = np.union1d(row[odd | far], row[begin][rest >= longest[row[begin]]])
                for k in some.tolist():  # few items have any
                    s0, s1 = off[k] - off[i], off[k + 1] - off[i]
                    stuck = stuck_samples(x[s0:s1], longest[k])
                    o, f = odd[s0:s1], far[s0:s1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (o | f | stuck).view(np.int8), [0]])))
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        kind = "+".join(name for name, on in (("range", o), ("spike", f & ~o), ("stuck", stuck & ~o)) if on[s:e].any())
                        out.append((k, s, e - s, kind))
            if out:
                at, first, many, kind = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(first, pa.int64()), pa.array(many, pa.int64()), pa.array(kind)], ["item_id", "first_sample", "samples", "kind"])

    return items.select("item_id", "level", "low", "high", "step", "lower", "upper", "longest", "samples").mapInArrow(run, "item_id bigint, first_sample bigint, samples bigint, kind string")


def flagged(queue: DataFrame, channels: DataFrame, hour: Column | None = None) -> DataFrame:
    """Problem 1: (item_id, first_sample, samples, kind) of every stretch of bad readings, a repeated item_id once.

    Bad are readings that are infinite, at or beyond the ends of the channel's range, beyond its cutoffs, or stuck. The
    cutoffs: residuals from the channel's level at that hour of the day are counted, their peaks over a threshold in each tail
    get a generalised Pareto fit (probability-weighted moments, shape checked for stability over thresholds), and the cutoff
    is what a normal reading exceeds with probability RISK. Stuck is a rest longer than the channel's rests, the tail of
    whose lengths is taken as geometric, ever get at that risk. Channels of any size are judged alike: the device's typical
    tail counts beside each channel's own. Items of a channel the device doesn't have give one row of first_sample -1 and kind
    'channel'; items of null channel, and null or empty lists, give none. Missing samples (null, NaN) are never bad and end
    a stretch. An item whose channel has no row among `channels` is judged by the widest range given there,
    or by none if there is none.

    Scans: three passes over the lists, none of which shuffles them; what is shuffled is counts per channel. Everything that
    is broadcast has a row per channel and hour at most, of the device's 512 channels.
    """
    c = F.col("m_channel_num")
    rows = one_row_per_key(queue.select("item_id", "m_channel_num", "queued_at", "m_reads"), "item_id")
    real = rows.where(c.between(*CHANNELS))
    wrong = rows.where(c.isNotNull() & ~c.between(*CHANNELS)).select("item_id", F.lit(-1).cast("bigint").alias("first_sample"), F.lit(0).cast("bigint").alias("samples"), F.lit("channel").alias("kind"))
    clock = F.coalesce(F.hour("queued_at") if hour is None else hour, F.lit(0))
    items = spread(real.where(F.size("m_reads") > 0)).select("item_id", c.alias("channel"), clock.alias("hour"), F.col("m_reads").alias("samples"))
    usable = channels.where(F.col("m_channel_num").between(*CHANNELS) & (F.col("adc_max") > F.col("adc_min")))
    span = usable.groupBy(F.col("m_channel_num").alias("channel")).agg(F.min("adc_min").cast("double").alias("own_low"), F.max("adc_max").cast("double").alias("own_high"))
    widest = usable.agg(F.min("adc_min"), F.max("adc_max")).first()
    any_low, any_high = (float("-inf"), float("inf")) if widest[0] is None else map(float, widest)
    step = 1.0 if widest[0] is None else (any_high - any_low) / STEPS
    level = checkpointed(levels(items))
    known = items.join(F.broadcast(level), ["channel", "hour"], "left").join(F.broadcast(span), "channel", "left")
    known = known.select("item_id", "channel", F.coalesce("level", F.lit(0.0)).alias("level"), F.coalesce("own_low", F.lit(any_low)).alias("low"), F.coalesce("own_high", F.lit(any_high)).alias("high"), F.lit(step).alias("step"), "samples")
    standard = cutoffs(checkpointed(tallies(known)))
    judged = known.join(F.broadcast(standard), "channel", "left").fillna({"lower": float("-inf"), "upper": float("inf"), "longest": float("inf")})
    return stretches(judged).unionByName(wrong)
