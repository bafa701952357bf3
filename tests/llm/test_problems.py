"""The operators for training data against brute force, round trips and awkward rows."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewave.llm import packing, pieces, quantiles, runs, tokens, topn, truncation

T0 = dt.datetime(2024, 1, 1)
QUEUE = "item_id long, m_channel_num long, queued_at timestamp, m_reads array<float>"


# runs


def test_repeats():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.integers(300, 900, 30), 8).astype(np.float32) + rng.normal(0, 5, 240).round().astype(np.float32)
    assert runs.repeats(x, x) and runs.repeats(x, x + 1) and runs.repeats(x, x[:-5])
    assert runs.repeats(x, x + rng.integers(-2, 3, 240)) and runs.repeats(x, np.delete(x, [50, 120]))
    gap = x.copy()
    gap[30:34] = np.nan
    assert runs.repeats(x, gap)
    half = np.concatenate([x[:120], x[::-1][:120]])
    assert not runs.repeats(x, half) and not runs.repeats(x, x[:120]) and not runs.repeats(x, x[::-1])
    assert not runs.repeats(x, np.zeros(0, np.float32)) and not runs.repeats(np.full(9, np.nan, np.float32), np.full(9, np.nan, np.float32))


def brute_runs(rows):
    seen, out = {}, []
    for item, channel, at, x in rows:
        if channel is not None and item is not None:
            seen[item] = (item, channel, at, x)
    for c in {r[1] for r in seen.values()}:
        order = sorted((r for r in seen.values() if r[1] == c), key=lambda r: (r[2], r[0]))
        start = 0
        for i in range(1, len(order) + 1):
            if i == len(order) or not runs.repeats(np.array(order[i - 1][3] or [], np.float32), np.array(order[i][3] or [], np.float32)):
                if i - start > 1:
                    out.append((order[start][0], order[i - 1][0], i - start))
                start = i
    return sorted(out)


def test_runs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, item, last = [], 0, None
    for i in range(300):
        x = last if last is not None and rng.random() < 0.5 else (rng.integers(200, 900, 40) * 1.0).tolist()
        if rng.random() < 0.05:
            x = [] if rng.random() < 0.5 else None
        rows.append((item, int(rng.choice([7, 7, 7, 8])), T0 + dt.timedelta(seconds=int(i // 3)), x))
        last, item = x or last, item + 1
    rows += [rows[5], rows[5], (900, None, T0, [1.0] * 40), (901, None, T0, [1.0] * 40)]
    df = spark.createDataFrame(rows, QUEUE).repartition(3)
    got = sorted((r.first_item_id, r.last_item_id, r["items"]) for r in runs.runs(df).collect())
    assert got == brute_runs(rows) and len(got) > 20
    assert runs.runs(df.where("false")).count() == 0


def test_events_recur_and_the_difference_tells_runs_apart(spark):
    rng = np.random.default_rng(3)
    a, b = ((rng.integers(200, 900, 60) * 1.0).tolist() for _ in range(2))
    row = lambda i, x: (i, 7, T0 + dt.timedelta(seconds=i), x)
    signals = [a, a, b, a, a, a, b, b, [], []]
    for parts in (1, 4):
        df = spark.createDataFrame([row(i, x) for i, x in enumerate(signals)], QUEUE).repartition(parts)
        events = {r.item_id: r.event for r in runs.canonical(runs.linked(df)).collect()}
        assert events[0] == events[1] == events[3] == events[5] != events[2] == events[6] and events[8] != events[9]
        assert sorted((r.first_item_id, r.last_item_id) for r in runs.runs(df).collect()) == [(0, 1), (3, 5), (6, 7)]


def test_equal_head_without_repeating_the_last_item_begins_anew(spark):
    x = np.repeat(np.arange(300.0, 900.0, 20), 8)
    drift = [(x + 2.5 * k).tolist() for k in range(5)] + [x.tolist()]
    df = spark.createDataFrame([(i, 7, T0 + dt.timedelta(seconds=i), y) for i, y in enumerate(drift)], QUEUE)
    assert [(r.first_item_id, r.last_item_id) for r in runs.runs(df).collect()] == [(0, 4)]


# percentiles


@given(st.lists(st.lists(st.integers(-1000, 1000), min_size=1, max_size=400), min_size=1, max_size=12), st.floats(0.001, 0.1))
@settings(max_examples=40, deadline=None)
def test_summary_bounds_hold(parts, error):
    s = quantiles.compress(quantiles.merge([quantiles.summarise(np.array(p, float)) for p in parts]), error)
    x = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert s[0] == len(x)
    for v, below, upto in zip(*s[1:]):
        assert (x < v).sum() <= below and (x <= v).sum() >= upto
    q = np.array([0.01, 0.25, 0.5, 0.75, 0.99])
    for p, v in zip(q, quantiles.quantile(s, q)):
        r = max(1, np.ceil(p * len(x)))
        off = max((x < v).sum() + 1 - r, r - (x <= v).sum(), 0)
        assert off <= quantiles.rank_error(s) * len(x) + 1


def test_percentiles_within_one_percent(spark):
    rng = np.random.default_rng(2)
    rows = [(1 if i % 3 else None, i % 2, rng.normal(size=800).tolist()) for i in range(60)] + [(1, 0, [float("nan"), float("inf")]), (2, 0, []), (3, 0, None)]
    df = spark.createDataFrame(rows, "c long, d int, v array<double>")
    days = quantiles.summaries(df, ["c", "d"], "v")
    got = {(r.c, r.percent): (r.value, r.n, r.rank_error) for r in quantiles.percentiles(quantiles.merged(days, ["c"]), ["c"]).collect()}
    for c in (1, None):
        x = np.sort(np.concatenate([r[2] for r in rows[:60] if r[0] == c]))
        for p in quantiles.PERCENTS:
            v, n, e = got[c, p]
            assert n == len(x) and e < 0.01 and abs((x <= v).sum() - p / 100 * n) <= 0.01 * n + 1
    assert {k[0] for k in got} == {1, None}
    assert quantiles.summaries(df.where("false"), ["c"], "v").count() == 0


def test_many_folds_stay_within_the_error():
    rng = np.random.default_rng(4)
    ladder, parts = quantiles.Ladder(), []
    for i in range(1000):
        parts.append(rng.normal(i % 7, 1 + i % 3, 3000))
        ladder.add(quantiles.summarise(parts[-1]))
    level, s = ladder.one()
    x = np.sort(np.concatenate(parts))
    assert s[0] == len(x) and level <= 4 and quantiles.rank_error(s) <= quantiles.ERROR < 0.01 and len(s[1]) < 2000
    assert max(map(len, ladder.levels)) < quantiles.FAN_IN
    for p, v in zip(quantiles.PERCENTS, quantiles.quantile(s, np.array(quantiles.PERCENTS) / 100)):
        r = np.ceil(p / 100 * len(x))
        assert max(np.searchsorted(x, v) + 1 - r, r - np.searchsorted(x, v, "right"), 0) <= quantiles.rank_error(s) * len(x) + 1


def test_many_summaries_of_a_key_are_merged_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i % 5, i, rng.normal(size=50).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "c long, d int, v array<double>").repartition(40)
    days = quantiles.summaries(df, ["c", "d"], "v").checkpoint()
    assert days.count() == 200 and quantiles.merged(days, ["c"]).count() == 5
    whole = quantiles.summaries(df, ["c"], "v").collect()
    assert [r.n for r in whole] == [2000] * 5 and max(r.rank_error for r in whole) <= quantiles.ERROR
    bad = days.withColumn("rank_error", days.rank_error + 0.011)
    with pytest.raises(Exception, match="certain only"):
        quantiles.percentiles(bad, ["c"]).collect()


# pieces


def test_gap_ends():
    x = np.ones(60)
    x[:12] = x[20:30] = x[35:44] = x[48:] = np.nan
    assert pieces.gap_ends(np.isnan(x)).tolist() == [30]


@given(st.integers(1, 4000), st.lists(st.integers(1, 3999), max_size=12), st.lists(st.integers(1, 3999), max_size=12))
@settings(max_examples=80, deadline=None)
def test_pieces_cover_within_the_limit(n, marks, gaps):
    marks, gaps = np.unique([m for m in marks if m < n]).astype(int), np.unique([g for g in gaps if g < n]).astype(int)
    got = pieces.pack(pieces.tree(n, marks, np.setdiff1d(gaps, marks)), 300, 20)
    assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]] and got[-1][1] == n
    for a, b, natural in got:
        assert 0 < b - a + (20 if a else 0) <= 300
        assert not natural or b == n or b in marks or b in gaps
    assert pieces.starts(pieces.tree(n, marks, np.setdiff1d(gaps, marks))) == np.union1d(marks, gaps).tolist()


def test_remnants_join_their_siblings():
    node = pieces.tree(700, np.array([450, 520]), np.array([200, 460]))
    assert pieces.pack(node, 300, 20) == [(0, 200, True), (200, 450, True), (450, 700, True)]
    # what is left of a leaf cut at the limit goes on with the next sequence
    assert pieces.pack(pieces.tree(400, np.array([350]), np.array([], int)), 300, 20) == [(0, 300, False), (300, 400, True)]
    # a sequence that fits by itself is not opened to fill the piece before
    assert pieces.pack(pieces.tree(500, np.array([250]), np.array([300])), 300, 20) == [(0, 250, True), (250, 500, True)]


def test_pieces_tables(spark):
    rng = np.random.default_rng(3)
    long = rng.integers(0, 9, 9000).astype(float)
    long[5000:5012] = np.nan
    queue = spark.createDataFrame([(1, long.tolist()), (1, long.tolist()), (2, [1.0] * 4096), (3, None), (4, [float("nan")] * 5000)], "item_id long, m_reads array<float>")
    cdtw = spark.createDataFrame([(1, long.tolist()), (2, [1.0])], "subject_id long, sub array<float>")
    offsets = spark.createDataFrame([(1, 5012), (1, 3000), (1, 3000), (1, 0), (1, 9000), (1, 9999), (1, None), (2, 1)], "subject_id long, end_pos long")
    assert sorted(map(tuple, pieces.boundaries(queue, cdtw, offsets).collect())) == [("cdtw", 1, 3000), ("cdtw", 1, 5012), ("wqueue", 1, 5012)]
    rows = pieces.pieces(queue, cdtw, offsets).where("tab = 'cdtw'").orderBy("piece").collect()
    whole = list(rows[0].samples)
    for a, b in zip(rows, rows[1:]):
        assert len(b.samples) <= 4096 and np.array_equal(b.samples[:64], a.samples[-64:], equal_nan=True)
        whole += b.samples[64:]
    assert np.array_equal(np.array(whole), long, equal_nan=True)
    assert pieces.boundaries(queue.where("false"), cdtw.where("false"), offsets).count() == 0


# top items


def test_top_matches_equal_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), rng.choice([0.0, 1e-9, 0.2, 0.2, 0.5, 1.0, float("nan"), None, 1.5, -0.1]), rng.choice([None, 0, 1, 2])) for i in range(3000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "match_id long, query_number int, p_value float, match_ordinal int")
    want = set()
    good = {r for r in rows if r[1] is not None and r[2] is not None and 0 <= r[2] <= 1}
    for q in (0, 1, 2):
        want |= {(q, r[0]) for r in sorted((r for r in good if r[1] == q), key=lambda r: (np.float32(r[2]), r[3] or 99, r[0]))[:5]}
    for limit in (10**6, 0):
        from pyspark.sql import functions as F

        p = F.col("p_value")
        valid = df.where(p.between(0, 1) & ~F.isnan(p))
        got = topn.top_n_per_group(valid, "query_number", "p_value", 5, [F.nullif(F.col("match_ordinal"), F.lit(0)).asc_nulls_last()], "match_id", F.floor(256 * F.sqrt(F.sqrt(p))), limit)
        assert {(r.query_number, r.match_id) for r in got.collect()} == want
    assert topn.best_matches(df.where("false")).count() == 0


# token ids


def plain():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})


def test_ids_equal_plain_encoding(spark):
    rng = random.Random(5)
    letters = list("ab'st  \n\t\r.,!0129é日本語　  \x85ñ💡’-_ll") + ["<|endoftext|>", "don't", "'ve"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["", None, " ", "x" * 5000, "日本" * 400]
    enc = plain()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (enc.encode_ordinary(t) if t else []) and counts[i] == len(got[i])
        assert not t or enc.decode(got[i]) == t
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_portions_of_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "PORTION", 10)
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaaa", None, "bbbbbb", "", "c" * 30, "d"])], ["k", "t"])
    got = list(tokens.portions(iter([b, b.slice(0, 0)])))
    assert [x.num_rows for x in got] == [4, 1, 1, 0] and pa.Table.from_batches(got).column(1).to_pylist() == b.column(1).to_pylist()


# packing


@pytest.mark.parametrize("seed", [0, 1])
def test_packing(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in np.concatenate([rng.integers(1, 120, 300), [77] * 150, rng.integers(100, 400, 40)])]
    rows = [*enumerate(sizes), (9000, 0), (9001, None), (9002, -4), (9003, 100), (9004, 200)]
    df = spark.createDataFrame(rows, "id long, n int")
    got = packing.pack(df, "id", "n", 100).toPandas()
    held = got.groupby("container")["size"].sum()
    assert held.max() <= 100
    whole = got.groupby("id")["size"].sum().to_dict()
    assert whole == {i: n for i, n in rows if n and n > 0}
    many = got.groupby("id").size()
    assert all(many[i] == 1 for i, n in rows if n and 0 < n <= 100)
    for _, g in got[got.id.isin(many[many > 1].index)].groupby("id"):
        g = g.sort_values("piece")
        assert g.start.tolist() == [0, *g["size"].cumsum().tolist()[:-1]]
    best = sorted((n % 100 for _, n in rows if n and n > 0 and n % 100), reverse=True)
    free: list[int] = []
    for n in best:  # best fit, one at a time
        fits = [g for g in free if g >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(100 - n)
    assert len(held[held.index.str.startswith("shared")]) <= 1.05 * len(free) + 1
    assert packing.pack(df.where("false"), "id", "n").count() == 0


def test_full_pieces_of_repeated_keys_are_apart(spark):
    got = packing.pack(spark.createDataFrame([(7, 3000), (7, 3000), (8, 2048)], "id long, n int"), "id", "n").toPandas()
    assert got.groupby("container")["size"].sum().max() <= 2048 and got["size"].sum() == 8048 and (got["size"] == 2048).sum() == 3


def test_containers_are_nearly_full(spark):
    rng = np.random.default_rng(7)
    sizes = [int(x) for x in rng.lognormal(6.2, 0.8, 3000)] + [333] * 1500
    got = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "id long, n int"), "id", "n").toPandas()
    held = got.groupby("container")["size"].sum()
    assert held.max() <= 2048 and held.sum() == sum(sizes) and held.sum() / (2048 * len(held)) >= 0.99


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_depths_equal_a_stack(counts):
    gaps, items = (np.array(x) for x in zip(*counts))
    below, above, take = packing.depths(gaps, items)
    stack = 0
    for v in range(len(gaps) - 1, -1, -1):
        assert below[v] == stack
        stack += gaps[v]
        assert above[v] == stack and take[v] == min(items[v], stack)
        stack -= take[v]


def test_sweep_gives_each_item_its_successor(spark, monkeypatch):
    rng = random.Random(9)
    gaps, items = ([rng.randint(1, 20) for _ in range(200)] for _ in range(2))
    count = lambda x: np.bincount(x, minlength=21)
    below, above, take = packing.depths(count(gaps), count(items))
    table = spark.createDataFrame([(v, int(below[v]), int(above[v]), 0, int(take[v])) for v in range(21)], "value int, below long, above long, lo long, take long")
    number = lambda df, group, key, out, x: packing.numbered(df, group, key, out, {v: int(n) for v, n in enumerate(count(x)) if n})
    for part in (10**6, 3):
        monkeypatch.setattr(packing, "PART", part)
        g = number(spark.createDataFrame(list(enumerate(gaps)), "container long, gap int"), "gap", "container", "rank", gaps)
        i = number(spark.createDataFrame(list(enumerate(items)), "item long, size int"), "size", "item", "no", items)
        got = packing.swept(g, i.select("size", "no"), table).collect()
        free, want = sorted(gaps), []
        for x in sorted(items, reverse=True):
            fits = [y for y in free if y >= x]
            if fits:
                free.remove(fits[0])
                want.append((fits[0], x))
        assert len(got) == 200 and sorted((r.gap, r.took_size) for r in got if r.took_size is not None) == sorted(want)
        assert len({(r.took_size, r.took_no) for r in got if r.took_size is not None}) == len(want)


# cut-off texts


def corpus(seed=6, n=900):
    rng = random.Random(seed)
    words = "the pump valve run report sample sheet was signed before lunch because two labels were swapped".split()
    sentence = lambda: (" ".join(rng.choice(words) for _ in range(rng.randint(5, 12)))).capitalize() + "."
    rows = []
    for i in range(n):
        t = f"Subject: {rng.choice(words)}\n\nHello,\n\n" + " ".join(sentence() for _ in range(rng.randint(3, 12))) + "\n\nKind regards\n" + rng.choice(["Ann", "Bob", "Cid"])
        source = rng.choice(["web", "feed"])
        cut = False
        if source == "web" and len(t) > 400:
            t, cut = t[:400], True
        elif source == "feed" and rng.random() < 0.1:
            t, cut = t[: rng.randint(60, len(t) - 20)], True
        rows.append((i, t, source, rng.choice(["en", "EN", None]), cut))
    return rows


def test_cut_off_texts(spark):
    rows = corpus()
    extra = [(9001, None, "web", "en", False), (9002, "", "web", "en", False), (9003, " \n", None, None, False)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string, lang string, cut boolean")
    got = truncation.scored(df.drop("cut"))
    found = {r.doc_id for r in got.where("cut_off").collect()}
    want = {r[0] for r in rows if r[4]}
    hit = len(found & want)
    assert hit / len(want) > 0.9 and hit / len(found) > 0.9
    assert got.count() == len(rows)
    shares = {r.source: r.share for r in truncation.shares(got).collect()}
    assert shares["web"] > shares["feed"]


def test_marks_are_learned(spark):
    rows = []
    for i, t, _, lang, _ in corpus(8, 1200):
        t = t.replace("\n", " ") if i % 5 else t
        cut = len(t) > 350
        rows.append((i, t[:350] + (" <to be had on paper>", "@@", "")[i % 3] if cut else t, "post", lang, cut, i % 3 if cut else 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cut boolean, kind int")
    texts = df.select(df.doc_id.alias("key"), "text", "source", "lang")
    assert {(r.mark, r.length) for r in truncation.limits(truncation.text_ends(texts)).where("unit = 'chars'").collect()} == {(" <to be had on paper>", 350), ("@@", 350), ("", 350)}
    assert {r.at_limit for r in truncation.placed(texts).collect()} == {"no", "yes", "marked"}
    found = {r.doc_id for r in truncation.scored(df.drop("cut", "kind")).where("cut_off").collect()}
    want = {r[0] for r in rows if r[4]}
    assert len(found & want) / len(want) > 0.9 and len(found & want) / len(found) > 0.9
    marked = {r[0] for r in rows if r[4] and r[5] < 2}
    assert len(found & marked) / len(marked) > 0.9


def test_contexts_reach_over_long_runs(monkeypatch):
    word = "w" * 5000
    texts = [f"x. {word} 7 up {word}", "ab, " * 9000, f"1 2 3 4 5 6 7 8 {word}{word}9", "q"]
    short = truncation.final_contexts(texts)
    monkeypatch.setattr(truncation, "TAIL", 1 << 20)
    assert (short == truncation.final_contexts(texts)).all()
    assert truncation.state("A: b\n\n" + "QUJD" * 2000) == "coded-even" and truncation.state("A: b\n\n" + "QUJD" * 2000 + "Q") == "coded-odd"


def test_cut_off_small_tables(spark):
    df = spark.createDataFrame([(1, "One text.", "a", "en"), (2, "One text.", None, None)], "doc_id long, text string, source string, lang string")
    assert truncation.scored(df).count() == 2
    assert truncation.scored(df.where("false")).count() == 0


def test_contexts_share_no_counts(spark):
    rng = random.Random(1)
    texts = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(20_000)})
    ctx = truncation.final_contexts(texts)
    for o, n in enumerate(truncation.ORDERS):
        assert len(set(ctx[:, o].tolist())) == len({t[-n:] for t in texts})
    texts = texts[:300] + ["ab" * 40, "aab" * 40, "x"]
    ctx = truncation.final_contexts(texts)
    ends = spark.createDataFrame([(c,) for c in {int(c) for c in ctx.ravel()}], "ctx long")
    got = {r.ctx: r.n for r in truncation.continued(spark.createDataFrame([(t,) for t in texts], "text string"), ends).collect()}
    assert len(got) == ends.count()
    for i, t in enumerate(texts[:-1]):
        for o, n in enumerate(truncation.ORDERS):
            assert got[ctx[i, o]] == sum(x[:-1].startswith(t[-n:], j) for x in texts for j in range(len(x)))


def test_queries_run_by_name():
    from tidewave.llm import queries

    assert {"p2_found", "p4_found", "p5_found", "p6_ids", "p8_found"} <= set(queries.QUERIES) and set(queries.SQL) <= set(queries.QUERIES)


def test_clashing_extra_columns(spark):
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("key", "part", "same", "channel", "at", "state", "rank", "n", "v", "size", "__bucket", "__g", "ctx", "samples", "marks", "tab")}
    x = [float(i % 7) for i in range(40)]
    queue = spark.createDataFrame([(1, 5, T0, x), (2, 5, T0, x)], QUEUE).withColumns(extra)
    assert [(r.first_item_id, r.last_item_id) for r in runs.runs(queue).collect()] == [(1, 2)]
    assert quantiles.summaries(queue, ["m_channel_num"], "m_reads").first().n == 80
    docs = spark.createDataFrame([(1, "One text.", "a", "en")], "doc_id long, text string, source string, lang string").withColumns(extra)
    assert truncation.scored(docs).count() == 1 and len(tokens.encode_corpus(docs).first().ids) > 0
    assert packing.pack(tokens.count_tokens(docs), "doc_id", "n_tokens").count() == 1
    matches = spark.createDataFrame([(1, 1, 0.5, None)], "match_id long, query_number int, p_value float, match_ordinal int").withColumns(extra)
    assert topn.best_matches(matches).count() == 1
    cdtw = spark.createDataFrame([(1, [1.0] * 5000)], "subject_id long, sub array<float>").withColumns(extra)
    offsets = spark.createDataFrame([(1, 100)], "subject_id long, end_pos long").withColumns(extra)
    assert pieces.pieces(queue, cdtw, offsets).count() == 3
