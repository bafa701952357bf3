"""Implausible readings: planted damage against exact places, and awkward rows."""

import datetime as dt

import numpy as np
import pytest

from tidewave.operators import spikes

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "item_id long, m_channel_num long, queued_at timestamp, m_reads array<float>, level string"


def signal(rng, n, low=300, high=540):
    x = np.repeat(rng.integers(low, high, n // 10 + 1), 10)[:n] + rng.normal(0, 6, n).round()
    return x.astype(float)


def test_rests_and_stuck():
    nan = np.nan
    x = np.array([5, 7, 7, 8, nan, 7, 8, 12, 13, 14.0])
    got = {(int(a), int(b)): int(n) for a, b, n in zip(*spikes.rests(x))}
    assert got[1, 7] == 5
    y = np.concatenate([[9.0, 4.0], [5.0] * 30, [6.0, 20.0]])
    assert np.flatnonzero(spikes.stuck_samples(y, 22)).tolist() == list(range(2, 32))
    assert not spikes.stuck_samples(y[:20], 22).any() and not len(spikes.rests(np.zeros(0))[0])


@pytest.mark.parametrize("items", [3, 60])
def test_planted_damage(spark, items):
    rng = np.random.default_rng(items)
    rows, want = [], set()
    for i in range(items):
        x = signal(rng, 500)
        if i % 3 == 0:
            x[100:103] = 1200 + rng.normal(0, 30, 3).round()
            x[200] = 4095
            x[300:340] = 411
            x[299], x[340] = 480, 350
            want |= {(i, 100), (i, 200), (i, 300)}
        if i % 3 == 1:
            x[50:53] = np.nan
            x[60] = np.inf
            x[400:402] = -9999
            want |= {(i, 60), (i, 400)}
        rows.append((i, 7, T0 + dt.timedelta(hours=i), x.tolist(), "x"))
    rows += [(1000, 600, T0, [1.0], "x"), (1001, -1, None, None, "x"), (1002, None, T0, [99999.0], "x"), (1003, 7, T0, [], "x"), (1004, 7, None, [float("nan")] * 3, "x")]
    rows += rows[:2] + rows[-5:-4]
    want |= {(1000, -1), (1001, -1)}
    df = spark.createDataFrame(rows, SCHEMA)
    channels = spark.createDataFrame([(7, 0, 4095), (8, 0, 8191)], "m_channel_num long, adc_min int, adc_max int")
    got = spikes.flagged(df, channels).collect()
    assert sorted((r.item_id, r.first_sample) for r in got) == sorted(want)
    assert {r.kind for r in got} >= {"spike", "stuck", "channel", "range"}


def test_empty_and_unknown(spark):
    df = spark.createDataFrame([], SCHEMA)
    channels = spark.createDataFrame([], "m_channel_num long, adc_min int, adc_max int")
    assert spikes.flagged(df, channels).count() == 0
    rng = np.random.default_rng(9)
    one = spark.createDataFrame([(1, 9, T0, [*signal(rng, 300).tolist(), float("inf")], "x")], SCHEMA)
    assert [(r.item_id, r.first_sample) for r in spikes.flagged(one, channels).collect()] == [(1, 300)]


def tally(rng, items=60, n=500, **signal_options):
    import pandas as pd

    rows = []
    for _ in range(items):
        x = signal(rng, n, **signal_options) - 420
        peaks = np.resize(x, (n // spikes.BLOCK, spikes.BLOCK))
        for what, at in (("r", x), ("u", peaks.max(1)), ("l", peaks.min(1)), ("s", spikes.rests(x)[2])):
            rows.append(pd.DataFrame({"channel": 7, "what": what, "at": at.astype(int), "n": 1}))
    return pd.concat(rows).groupby(["channel", "what", "at"], as_index=False).sum()


DEVICE = {"u": (0.0, 0.05), "l": (0.0, 0.05), "s": (0.0, 0.2)}


def test_the_tail_fit_decides(monkeypatch):
    rng = np.random.default_rng(3)
    t = tally(rng)
    later = np.concatenate([signal(rng, 500) - 420 for _ in range(400)])
    low, high, longest = spikes.fit(t, DEVICE)
    assert not ((later < low) | (later > high)).any() and high < 400 and low > -400 and 8 < longest < 25
    wide = spikes.fit(tally(np.random.default_rng(3), low=200, high=700), DEVICE)
    assert wide[1] > high + 50 and wide[0] < low - 50
    monkeypatch.setattr(spikes, "tail_reach", lambda *_: 0.0)
    monkeypatch.setattr(spikes, "rest_reach", lambda *_: 0.0)
    low, high, longest = spikes.fit(t, DEVICE)
    assert ((later < low) | (later > high)).sum() > 100 and longest < 5


def test_l_moments_equal_brute_force():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 30, 400).astype(float)
    v, n = np.unique(x, return_counts=True)
    many, mean, second = spikes.l_moments(v, n.astype(float))
    pairs = np.abs(x[:, None] - x[None, :])
    assert many == 400 and mean == pytest.approx(x.mean()) and second == pytest.approx(pairs.sum() / (400 * 399) / 2)
    assert spikes.l_moments(v[:0], n[:0].astype(float)) == (0.0, 0.0, 0.0)


def test_shape_must_be_stable():
    assert spikes.stable_shape([-0.9, -0.7, -0.5], 1e9) == 0.0
    assert spikes.stable_shape([-0.3, -0.31, -0.3], 1e9) == pytest.approx(-0.3)
    assert 0 < spikes.stable_shape([0.02, 0.03, 0.05], 500.0) < 0.05
    assert spikes.tail_reach(5.0, -0.3, 0.02) < spikes.tail_reach(5.0, 0.0, 0.02) < spikes.tail_reach(5.0, 0.1, 0.02) < spikes.tail_reach(15.0, 0.1, 0.02)


def test_rests_end_at_the_edges_of_lists():
    x = np.full(40, 5.0)
    begin, end, n = spikes.rests(x, np.repeat([0, 1], 20))
    assert sorted({(int(a), int(b), int(k)) for a, b, k in zip(begin, end, n)}) == [(0, 20, 20), (20, 40, 20)]
    assert list(spikes.portions(np.array([0, 5, 5, 3 << 20, (3 << 20) + 7]))) == [(0, 2), (2, 3), (3, 4)]
