"""The registered queries against their SQL on the smallest test data."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
FAST = ["stats_channels", "znorm_local", "welford_rolling", "merge_offsets", "locate_position", "interval_overlap_any_name", "interval_anti", "rank_competition", "fdr_monotone", "decisions", "rank_sum", "prefix_unique", "mini_dtw_soft", "collinear_pairs", "in_strand_ranges", "revcomp"]


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the test data isn't here")
@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in names)} from ({entry.oracle_sql()[name]})").fetchall()
    got = df.select(*names).collect()
    assert sorted(map(repr, (tuple(map(plain, r)) for r in got))) == sorted(map(repr, (tuple(map(plain, r)) for r in want)))


@pytest.mark.skipif(not DATA.exists(), reason="the test data isn't here")
def test_flagship(spark):
    assert entry.entry(spark).columns[:3] == ["query_id", "subject_id", "p_value"]
