"""SQL with the same rows as the registered queries, written for DuckDB over the whole tables."""

from __future__ import annotations

from tidewave.functions.scalars import ERF, ERF_P
from tidewave.operators.dtw import band

ITEMS = "(select item_id, any_value(m_channel_num) as m_channel_num, any_value(m_reads) as m_reads from wqueue group by item_id)"
READINGS = f"(select item_id, m_channel_num, cast(v as double) as v from (select item_id, m_channel_num, unnest(m_reads) as v from {ITEMS}) where v is not null and not isnan(v) and abs(v) < 1e6)"
MATCHES = """(select distinct match_id, query_number, subject_id, cast(p_value as double) as p_value, left_anchor_query, right_anchor_query,
  left_anchor_subject, right_anchor_subject, num_anchors from algo_datatypes where query_number is not null and p_value between 0 and 1 and not isnan(p_value))"""
EVENT_STATS = "(select user_id, avg(value) as mean, stddev_pop(value) as sd, count(value) as n from events group by user_id)"


def z(value: str, mean: str, sd: str) -> str:
    return f"case when {sd} > 0 then ({value} - {mean}) / {sd} when {sd} = 0 then 0.0 end"


def stats(key: str) -> str:
    many = "case when count(v) >= 2 then {} end"
    return f"select {key}, count(v) as n, {many.format('round(avg(v) + 1e-7, 4)')} as mean, {many.format('round(stddev_pop(v) + 1e-7, 4)')} as sd, {many.format('min(v)')} as low, {many.format('max(v)')} as high from {READINGS} where {key} is not null group by {key}"


SPANS = """(select subject_id, seq_name, coalesce(lag(end_pos) over (partition by subject_id order by end_pos), 0) as "start", end_pos as "end"
  from (select o.subject_id, o.end_pos, min(o.seq_name) as seq_name from subject_offsets o join cdtw c using (subject_id)
        where o.end_pos > 0 and o.end_pos <= len(c.sub) group by 1, 2))"""
LOCATED = f"""(select m.match_id, s.seq_name, m.left_anchor_subject - s."start" as local_pos, m.left_anchor_subject, m.right_anchor_subject
  from {MATCHES} m join {SPANS} s on m.subject_id = s.subject_id and m.left_anchor_subject >= s."start" and m.left_anchor_subject < s."end")"""


def clean(name: str) -> str:
    return f"regexp_replace(regexp_replace({name}, '^\\s*>?\\s*', ''), '\\s+$', '')"


PLACED = f"(select match_id, {clean('seq_name')} as name, local_pos as \"start\", local_pos + right_anchor_subject - left_anchor_subject as stop from {LOCATED} where seq_name is not null)"
BED = f"(select distinct {clean('seq_name')} as name, least(start_pos, end_pos) as \"start\", greatest(start_pos, end_pos) - 1 as stop from bed_intervals where seq_name is not null and start_pos is not null and end_pos is not null and start_pos <> end_pos)"
OVERLAP = 'a."start" <= a.stop and b."start" <= b.stop and b.stop >= a."start" and b."start" <= a.stop'
HIT = f"(select distinct a.match_id from {PLACED} a join {BED} b on a.name = b.name and {OVERLAP})"

RANKED = f"""(select *, rank() over w as rank, dense_rank() over w as dense_rank, count(*) over (partition by query_number) as n,
  count(*) over (partition by query_number order by p_value range between unbounded preceding and current row) as upto
  from {MATCHES} window w as (partition by query_number order by p_value))"""


def decisions(max_p: float, negative: bool, overlap: bool) -> str:
    best = f"(select query_number, min(p_value) as p from {MATCHES} group by 1)"
    hit = f"(select b.query_number, bool_or(h.match_id is not null) as o from {best} b join {MATCHES} m on m.query_number = b.query_number and m.p_value = b.p left join {HIT} h using (match_id) group by 1)"
    good = "case when o then 'accept' else 'eject' end" if overlap else f"'{'eject' if negative else 'accept'}'"
    reason = "case when o then 'in_interval' else 'outside_intervals' end" if overlap else "'match'"
    return f"""select q.query_number, b.p as p_value,
  case when b.p is null then 'none' when b.p <= {max_p} then {good} else '{'accept' if negative else 'eject'}' end as action,
  case when b.p is null then 'no_match' when b.p > {max_p} then 'weak_match' else {reason} end as reason
from (select distinct query_number from algo_datatypes where query_number is not null) q left join {best} b using (query_number)
{'left join ' + hit + ' h using (query_number)' if overlap else ''}"""


def erf(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs({x})))"
    return f"(sign({x}) * (1 - {t} * ({ERF[0]} + {t} * ({ERF[1]} + {t} * ({ERF[2]} + {t} * ({ERF[3]} + {t} * {ERF[4]})))) * exp(-({x}) * ({x}))))"


BASES = "regexp_replace(translate(text, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'A', 'g')"
DNA_BASES = "regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'A', 'g')"


def anchors(size: int, warp: int | None, bucket: int = 1024, more: str = "") -> str:
    """Best window of each bucket and block, the alignment written out cell by cell; `more` is added to the cost of subject offset {j}."""
    rows = band(size, warp)
    leads = ", ".join(f"lead(value, {j}) over (order by event_id) as s{j}" for j in range(size))
    sql = f"""select query_id, bucket, block, pos, q, {', '.join(f's{j}' for j in range(size))}
  from (select event_id as pos, event_id // {bucket} as bucket, {leads} from events) w,
    (select vec_id as query_id, b as block, [cast(x as double) * 100 for x in embedding[b * {size} + 1 : b * {size} + {size}]] as q
     from (select vec_id, embedding, unnest(range(len(embedding) // {size})) as b from embeddings where vec_id % 100 = 0)) k
  where s{size - 1} is not null"""
    for i, cols in enumerate(rows):  # a select for each cell: aliases within one would be expanded again and again
        for j in cols:
            froms = [f"c{a}_{b}" for a, b in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if a >= 0 and b >= 0 and b in rows[a]]
            cost = f"(q[{i + 1}] - s{j}) * (q[{i + 1}] - s{j})" + more.replace("{j}", str(j))
            sql = f"select *, {cost}{' + least(' + ', '.join(froms) + ')' if froms else ''} as c{i}_{j} from ({sql})"
    dist = f"c{size - 1}_{size - 1}"
    return f"(select query_id, bucket, block, arg_min(pos, ({dist}, pos)) as pos, min({dist}) as dist from ({sql}) group by 1, 2, 3)"


def collinear(i: int, j: str) -> str:
    """Whether block j's anchor lies where block i's lets it be, a quarter more or less."""
    gap = f"10 * ({j} - {i})"
    return f"p[{j}] >= p[{i}] + floor({gap} * 0.75) and p[{j}] <= p[{i}] + floor({gap} * 1.25)"


def chain_extents(blocks: int = 6) -> str:
    """Chains of each bucket: memberships seed by seed, then a longest increasing subsequence, the latest of equals."""
    sql = f"select query_id, bucket, list(pos order by block) as p, [{', '.join(['-1'] * blocks)}] as m, 0 as num from {anchors(10, None, 64)} group by 1, 2"
    for i in range(1, blocks + 1):
        free = f"m[j] < 0 and {collinear(i, 'j')}"
        some = f"len(list_filter(range({i + 1}, {blocks + 1}), lambda j: {free})) > 0"
        joins = f"list_transform(range(1, {blocks + 1}), lambda j: case when j = {i} or (j > {i} and {free}) then num else m[j] end)"
        sql = f"select query_id, bucket, p, case when m[{i}] < 0 and {some} then {joins} else m end as m, num + case when m[{i}] < 0 then 1 else 0 end as num from ({sql})"
    sql = f"select query_id, bucket, p, g, list_filter(range(1, {blocks + 1}), lambda j: m[j] = g) as w from (select *, unnest(list_distinct(list_filter(m, lambda x: x >= 0))) as g from ({sql}))"
    sql = f"select query_id, bucket, g, w, list_transform(w, lambda j: p[j]) as x, len(w) as n, [1] as l from ({sql})"
    for i in range(2, blocks + 1):
        sql = f"select * exclude (l), case when n >= {i} then list_append(l, 1 + list_max(list_transform(range(1, {i}), lambda k: case when x[k] < x[{i}] then l[k] else 0 end))) else l end as l from ({sql})"
    sql = f"select *, list_max(l) as top from ({sql})"
    sql = f"select *, list_max(list_filter(range(1, n + 1), lambda k: l[k] = top)) as last from ({sql})"
    sql = f"select *, last as c from ({sql})"
    for _ in range(blocks - 1):
        sql = f"select * exclude (c), case when l[c] > 1 then list_max(list_filter(range(1, c), lambda k: l[k] = l[c] - 1)) else c end as c from ({sql})"
    return f"""select query_id, cast(0 as bigint) as subject_id, bucket, cast(g as integer) as member, cast((w[c] - 1) * 10 as integer) as left_query,
  cast((w[last] - 1) * 10 as integer) as right_query, x[c] as left_subject, x[last] as right_subject, cast(top as integer) as num_anchors from ({sql}) where top > 1"""


NEAREST = """
with flat as (select subject_id, unnest(sub) as v, unnest(range(len(sub))) as pos, len(sub) as n from cdtw where len(sub) >= 64),
sound as (select subject_id, pos, n, case when isfinite(v) then cast(v as double) end as v from flat),
w as (select subject_id, pos, n, count(v) over f as k, avg(v) over f as mean, stddev_pop(v) over f as sd from sound
      window f as (partition by subject_id order by pos rows between current row and 63 following)),
q as (select vec_id as query_id, list_transform(embedding, lambda x: cast(x as double) * 100) as x from embeddings where vec_id % 100 = 0),
z as (select query_id, unnest(range(64)) as k, unnest(list_transform(x, lambda v: (v - list_avg(x)) / list_stddev_pop(x))) as z from q),
dots as (select query_id, subject_id, pos - k as pos, sum(v * z) as dot from sound, z where pos >= k group by 1, 2, 3),
d as (select query_id, subject_id, pos, case when sd > 0 then sqrt(greatest(128 - 2 * dot / sd, 0)) else 8.0 end as dist
      from w join dots using (subject_id, pos) where k = 64 and pos <= n - 64)
select query_id, subject_id, arg_min(pos, (round(dist, 9), pos)) as pos, round(min(dist), 6) as dist from d group by 1, 2"""

def pairs(first: str, last: str) -> str:
    """Pairwise alignment row by row: `first` gives the row of the query's first sample, `last` picks the cost from the last row."""
    return f"""
with q as (select vec_id as query, list_transform(embedding, lambda v: cast(v as double)) as a from embeddings where vec_id % 100 = 0),
s as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as b from embeddings)
select query, vec_id, round(sqrt(list_reduce(list_transform(a[2:], lambda v: [v]), lambda up, v:
    list_reduce(list_transform(range(2, len(b) + 1), lambda j: [cast(j as double)]), lambda r, j: list_append(r, (v[1] - b[cast(j[1] as bigint)]) ** 2
        + least(r[len(r)], up[cast(j[1] as bigint)], up[cast(j[1] as bigint) - 1])), [up[1] + (v[1] - b[1]) ** 2]),
  {first}){last}), 6) as distance
from q, s where query <> vec_id"""


CLOSED = "list_reduce(list_transform(range(2, len(b) + 1), lambda j: [cast(j as double)]), lambda r, j: list_append(r, r[len(r)] + (a[1] - b[cast(j[1] as bigint)]) ** 2), [(a[1] - b[1]) ** 2])"
OPEN = "list_transform(b, lambda v: (a[1] - v) ** 2)"



def encoded(k: int, bases: str, strands: tuple[bool, bool], value: str) -> str:
    """Number and sum of the model's values along the chosen strands of each text."""
    texts = " union all ".join(t for t, on in ((f"select doc_id, {bases} as s from documents where text is not null", strands[0]), (f"select doc_id, reverse(translate({bases}, 'ACGT', 'TGCA')) as s from documents where text is not null", strands[1])) if on)
    number = " + ".join(f"(instr('ACGT', substr(s, i + {j}, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))
    return f"""select d.doc_id, cast(count(k) as integer) as n, round(coalesce(sum(coalesce(v, 0.0)), 0.0) + 1e-5, 2) as total from documents d
left join (select doc_id, {number} as k from (select doc_id, s, unnest(range(1, len(s) - {k - 2})) as i from ({texts}))) using (doc_id)
left join (select event_id % {4**k} as m, {value} as v from events group by 1) on k = m where d.text is not null group by 1"""


def piece(n: int) -> str:
    """Least cost of aligning samples n .. n + 15 by absolute differences, the first step being diagonal."""
    a, b = f"a[{n + 1}:{n + 16}]", f"b[{n + 1}:{n + 16}]"
    far = "cast('inf' as double)"
    return f"""list_reduce(list_transform({a}[2:], lambda v: [v]), lambda up, v:
    list_reduce(list_transform(range(2, 17), lambda j: [cast(j as double)]), lambda r, j: list_append(r, abs(v[1] - {b}[cast(j[1] as bigint)])
        + least(r[len(r)], up[cast(j[1] as bigint)], up[cast(j[1] as bigint) - 1])), [{far}]),
  list_transform(range(1, 17), lambda j: case when j = 1 then abs({a}[1] - {b}[1]) else {far} end))[16]"""


STITCHED = f"""select vec_id, round({' + '.join(piece(n) for n in range(0, 64, 16))}, 6) as cost from (
select q.vec_id, list_transform(q.embedding, lambda v: cast(v as double)) as a, list_transform(s.embedding, lambda v: cast(v as double)) as b
from embeddings q join embeddings s on s.vec_id = q.vec_id + 1 where q.vec_id % 100 = 0)"""

FDR = "least(1.0, n * p_value / rank)"
SQL: dict[str, str] = {
    "stats_items": stats("item_id"),
    "stats_channels": stats("m_channel_num"),
    "znorm_local": f"select event_id, user_id, round({z('value', 'mean', 'sd')}, 6) as z from events join {EVENT_STATS} using (user_id)",
    "znorm_global": f"select event_id, round({z('value', 'mean', 'sd')}, 6) as z from events, (select avg(value) as mean, stddev_pop(value) as sd from events)",
    "znorm_percentile": """select event_id, round(case when b > a then (value - a) / (b - a) else 0.0 end, 6) as z from events
join (select user_id, quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from events group by 1) using (user_id)""",
    "rescale_to_subject": f"select event_id, round(({z('value', 's.mean', 's.sd')}) * t.sd + t.mean, 6) as z from events join {EVENT_STATS} s using (user_id), (select avg(value) as mean, stddev_pop(value) as sd from events) t",
    "welford_rolling": f"""select event_id, round({z('value', 'mean', 'sd')}, 6) as z from (
select event_id, value, avg(value) over w as mean, case when count(value) over w > 1 then stddev_samp(value) over w else 1.0 end as sd
from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))""",
    "strided_sample": "select event_id, value from events where event_id % 16 = 0",
    "merge_offsets": 'select subject_id, cast(e - n as bigint) as "start", cast(e as bigint) as "end" from (select subject_id, n, sum(n) over (order by subject_id) as e from (select subject_id, len(sub) as n from cdtw where len(sub) > 0))',
    "subject_long": "select subject_id, cast(i as integer) as local_pos, v as value from (select subject_id, unnest(sub) as v, unnest(range(len(sub))) as i from cdtw) where v is not null and not isnan(v)",
    "sequence_spans": f"select * from {SPANS}",
    "locate_position": f"select match_id, seq_name, local_pos from {LOCATED}",
    "interval_overlap": f'select a.match_id, a.name, b."start" as r_start, b.stop as r_stop from {PLACED} a join {BED} b on a.name = b.name and {OVERLAP}',
    "interval_overlap_any_name": f'select a.match_id, count(*) as n from {PLACED} a join {BED} b on {OVERLAP} group by 1',
    "interval_overlap_any_name_all": f'select a.match_id, count(*) as n from {PLACED} a join {BED} b on {OVERLAP} group by 1',
    "interval_contained": f'select a.name, a."start", a.stop, b.match_id as r_match_id from {BED} a join {PLACED} b on a.name = b.name and b."start" <= b.stop and b."start" >= a."start" and b.stop <= a.stop',
    "interval_stab": f'select a.match_id, b."start" as r_start, b.stop as r_stop from {PLACED} a join {BED} b on a.name = b.name and a."start" between b."start" and b.stop',
    "interval_semi": f"select match_id from {HIT}",
    "interval_anti": f"select match_id from {PLACED} where match_id not in (select match_id from {HIT})",
    "interval_extent": f'select min("start") as "start", max(stop) as stop from {BED}',
    "rank_competition": f"select match_id, query_number, rank from {RANKED}",
    "rank_dense": f"select match_id, query_number, dense_rank from {RANKED}",
    "fdr_plain": f"select match_id, round({FDR}, 9) as q from {RANKED}",
    "fdr_monotone": f"select match_id, round(min(least(1.0, n * p_value / upto)) over (partition by query_number order by p_value desc range between unbounded preceding and current row), 9) as q from {RANKED}",
    "matches_limited": f"""select match_id, query_number, rank from (select *, rank() over w as rank, count(*) over (partition by query_number) as n
  from {MATCHES} where p_value < 0.05 window w as (partition by query_number order by p_value)) where {FDR} <= 0.2 and rank <= 3""",
    "matches_sorted": f"select match_id, p_value, left_anchor_query, right_anchor_query, left_anchor_subject from {MATCHES} order by 2, 3, 4, 5",
    "decisions": decisions(0.01, False, True),
    "decisions_negative": decisions(0.001, True, False),
    "rank_sum": f"""select user_id, m, n, u, round(case when m > 0 and n > 0 then ({erf('(zz / sqrt(2))')} + 1) / 2 end, 5) as p_value from (
select *, (u - m * n / 2) / sqrt(m * n * (m + n + 1) / 12) as zz from (
select a.user_id, cast(count(*) filter (a.c) as bigint) as m, cast(count(*) filter (not a.c) as bigint) as n, cast(coalesce(sum(a.o) filter (a.c), 0) as bigint) as u from (
  select user_id, event_type = 'click' as c, count(*) filter (event_type <> 'click') over (partition by user_id order by value range between unbounded preceding and current row)
    - count(*) filter (event_type <> 'click') over (partition by user_id, value) as o from events) a group by 1))""",
    "kmer_index": f"""select source, cast(k as integer) as kmer, count(*) as n from (
select source, (instr('ACGT', substr(s, i, 1)) - 1) * 256 + (instr('ACGT', substr(s, i + 1, 1)) - 1) * 64 + (instr('ACGT', substr(s, i + 2, 1)) - 1) * 16
  + (instr('ACGT', substr(s, i + 3, 1)) - 1) * 4 + instr('ACGT', substr(s, i + 4, 1)) - 1 as k
from (select source, s, unnest(range(1, len(s) - 3)) as i from (select source, {BASES} as s from documents where text is not null))) group by 1, 2""",
    "revcomp": f"select doc_id, md5(reverse(translate({DNA_BASES}, 'ACGT', 'TGCA'))) as digest from documents where text is not null",
    "prefix_unique": """
with names as (select distinct seq_name as name, upper(seq_name) as seq from subject_offsets where seq_name is not null),
pairs as (select name, seq, unnest([lag(seq) over o, lead(seq) over o]) as other from names window o as (order by seq, name)),
shared as (select name, len(seq) as n, coalesce(len(list_filter(range(1, least(len(seq), len(other)) + 1), lambda i: left(seq, i) = left(other, i))), 0) as p from pairs)
select name, cast(max(p) as integer) as prefix_len, cast(least(max(p) + 3, max(n)) as integer) as kept_len, cast(max(n) - max(p) as integer) as suffix_len from shared group by name""",
    "mini_dtw_hard": f"select query_id, bucket, cast(block as integer) as block, pos, round(dist, 4) as dist from {anchors(10, None)}",
    "mini_dtw_deviation": f"select query_id, bucket, cast(block as integer) as block, pos, round(dist, 4) as dist from {anchors(10, None, more=' + (3 - (pos + {j}) % 7) ** 2')}",
    "mini_dtw_soft": f"select query_id, bucket, cast(block as integer) as block, pos, round(dist, 4) as dist from {anchors(12, 3)}",
    "collinear_pairs": f"""select query_id, bucket, cast(block as integer) as block, cast(nb as integer) as next_block from (
select *, lead(block) over w as nb, lead(pos) over w as np from {anchors(10, None, 64)} window w as (partition by query_id, bucket order by block))
where np >= pos + floor(10 * (nb - block) * 0.75) and np <= pos + floor(10 * (nb - block) * 1.25)""",
    "encode_signal": encoded(5, BASES, (True, True), "avg(value)"),
    "encode_signal_dna": encoded(6, DNA_BASES, (True, True), "avg(value)"),
    "encode_signal_complement_sd": encoded(6, DNA_BASES, (False, True), "coalesce(stddev_pop(value), 0.0)"),
    "stitched_pairs": STITCHED,
    "latest_samples": """select item_id, cast(len(h) as integer) as n, round(coalesce(list_sum(list_transform(h, lambda v: case when v is null or isnan(v) or abs(v) >= 1e6 then 0.0 else cast(v as double) end)), 0.0), 3) as total from (
  select item_id, list_concat(x[1:10], x)[-100:] as h from (select item_id, any_value(m_reads) as x from wqueue group by item_id) where len(x) > 0)""",
    "chain_extents": chain_extents(),
    "sorted_distance_sample": f"""select query_id, cast(block as integer) as block, row_number() over (partition by query_id, block order by dist, bucket) - 1 as place, round(dist, 4) as dist from (
select *, row_number() over (partition by query_id, block order by bucket) - 1 as b from {anchors(10, None, 64)}) where b % 4 = 0""",
    "nearest_window": NEAREST,
    "dtw_pairs": pairs(CLOSED, "[len(b)]"),
    "dtw_open_pairs": pairs(OPEN, ".list_min()"),
    "in_strand_items": """select item_id, case when len(x) >= 10 then list_reduce(list_transform(x[11:], lambda v: [v]),
    lambda s, v: [s[1] + v[1] / 10 - s[1] / 10, greatest(s[2], case when s[1] + v[1] / 10 - s[1] / 10 between 300 and 1300 then 1.0 else 0.0 end)],
    [m, case when m between 300 and 1300 then 1.0 else 0.0 end])[2] = 1 else false end as in_strand
from (select item_id, x, list_reduce(list_transform(x[1:10], lambda v: v / 10), lambda a, b: a + b, cast(0.0 as double)) as m from (
  select item_id, list_transform(any_value(m_reads), lambda v: case when v is null or isnan(v) then cast(0.0 as double) else cast(v as double) end) as x from wqueue where m_reads is not null group by item_id))""",
    "in_strand_average": """select user_id, bool_or(n = 10 and mean between 40.0 and 60.0) as in_strand from (
select user_id, avg(value) over w as mean, count(value) over w as n from events window w as (partition by user_id order by ts, event_id rows 9 preceding)) group by 1""",
    "in_strand_ranges": """select user_id, event_id as "start", coalesce(lead_id, most + 1) as "end" from (
select user_id, event_type, event_id, lead(event_id) over (partition by user_id order by event_id) as lead_id, max(event_id) over (partition by user_id) as most from events) where event_type = 'view'""",
    "channel_parts": f"select case when m_channel_num between 1 and 512 then least((m_channel_num - 1) // 102, 4)::integer else -1 end as part, count(*) as n from {ITEMS} group by 1",
    "stream_channel_state": f"""select channel, n, round(mean, 4) as mean, round(ssq / greatest(n, 1), 3) as ssq from (
select i.m_channel_num as channel, count(v) as n, coalesce(avg(v), 0.0) as mean, coalesce(sum(v * v) - count(v) * avg(v) * avg(v), 0.0) as ssq
from {ITEMS} i left join {READINGS} r using (item_id) where i.m_channel_num between 1 and 512 group by 1)""",
}
