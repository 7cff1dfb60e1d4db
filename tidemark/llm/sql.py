"""SQL of the queries of operators 11 to 13, as DuckDB runs it."""

OP11 = r"""
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
first as (select text, min(doc_id) as first_id from w group by 1),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
f as (
  select part, coalesce(good, false)::int as good, coalesce(toxic, false)::int as toxic,
    (len(words) < 200)::int
    + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > first_id, false)::int as mask
  from w join first using (text) left join said using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
letter(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letter a, letter b, letter c, letter d, letter e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct(bits)) = 5),
steps as (select filter_order, step::int as step, bits[step] as bit, coalesce(list_sum(bits[1 : step - 1]), 0)::bigint as before from orders, range(1, 6) as t(step)),
found as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & before = 0 and mask & bit = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from cells, steps group by all)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from found
"""


def _plus(prefix: str, cost: str, edit: str) -> str:
    """A prefix of edits is its cost in nine digits, then its audit; so the least string is the cheapest and, of those, the least audit."""
    return f"lpad((left({prefix}, 9)::int + {cost})::varchar, 9, '0') || substr({prefix}, 10) || '{edit}'"


_SAME = "is not distinct from"
OP12 = rf"""
with recursive
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (
  select *, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, _z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 as k
  from keyed),
harmed as (
  select conv_id, turn, case k when 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) as copy
  from hashed),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen
  from harmed),
faulty as (
  select conv_id, turn, role, text, i, left(role, 1) as r,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when seen > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from placed),
coded as (select *, fault not in ('blank', 'duplicate') as stays, case fault when 'truncated' then 5 else 0 end as t, lag(r) over (partition by conv_id order by i) as prior from faulty),
state(conv_id, i, a0, a1, a2, a3) as (
  select distinct conv_id, 0::bigint, '000000000', null::varchar, '000000005I', '000000010II' from coded
  union all
  select conv_id, i, b0, b1, c2, least(b3, {_plus("c2", "5", "I")}) from (
    select *, least(b2, {_plus("b0", "5", "I")}, {_plus("b1", "5", "I")}, {_plus("b3", "5", "I")}) as c2 from (
      select f.conv_id, f.i, {_plus("a0", "2", "D")} as b0,
        least({_plus("a1", "2", "D")}, case when stays and r = 's' then {_plus("a0", "t", "K")} end) as b1,
        least({_plus("a2", "2", "D")},
          case when stays and r = 'u' then least({_plus("a0", "t", "K")}, {_plus("a1", "t", "K")}, {_plus("a3", "t", "K")}) end,
          case when stays then least({_plus("a0", "1 + t", "R")}, {_plus("a1", "1 + t", "R")}, {_plus("a3", "1 + t", "R")}) end) as b2,
        least({_plus("a3", "2", "D")}, case when stays and r = 'a' then {_plus("a2", "t", "K")} end, case when stays then {_plus("a2", "1 + t", "R")} end) as b3
      from state s join coded f on f.conv_id {_SAME} s.conv_id and f.i = s.i + 1))),
ended as (
  select s.conv_id, left(least(a0, a3), 9)::bigint as cost, substr(least(a0, a3), 10) as audit
  from state s join (select conv_id, max(i) as n from coded group by 1) n on n.conv_id {_SAME} s.conv_id and n.n = s.i),
edits as (
  select conv_id, p, audit[p] as e, length(replace(audit[1:p], 'I', '')) as i, length(replace(audit[1:p], 'D', '')) as place
  from ended, unnest(range(1, length(audit) + 1)) as t(p)),
written as (
  select e.conv_id, e.p, e.e, e.place, f.role, f.text, first_value(e.e = 'K' and f.r = 's') over (partition by e.conv_id order by e.p) as system
  from edits e left join faulty f on f.conv_id {_SAME} e.conv_id and f.i = e.i where e.e <> 'D'),
lines as (
  select conv_id, p, case when e = 'K' then role when (place - system::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case e when 'I' then '' else text end as line
  from written),
repaired as (select conv_id, string_agg(line, chr(10) order by p) as text from lines group by 1),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (i > 1 and prior || r not in ('su', 'ua', 'au')) as illegal
  from coded group by 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted on counted.conv_id {_SAME} c.conv_id left join ended on ended.conv_id {_SAME} c.conv_id left join repaired on repaired.conv_id {_SAME} c.conv_id
"""

OP13 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('0:' || coalesce(doc_id::varchar, '')) as key from documents),
n as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by 1),
s as (select source, source_size, case k % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as cap from n),
total as (select 1.5::double * sum(source_size) as words from s),
-- each run of clamped sources, lowest cap for its weight first, gives a level; the highest of them is the one that fills
runs as (select cap / weight as ratio, sum(cap) over w - cap as clamped, sum(weight) over () - sum(weight) over w + weight as free from s window w as (order by cap / weight, source rows unbounded preceding)),
filled as (select max((words - clamped) / free) as water from runs, total),
aimed as (select source, source_size, least(cap, weight * water) as target from s, filled),
parts as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::int as whole from aimed),
placed as (select *, coalesce(sum(size) over (partition by source order by key, size rows between unbounded preceding and 1 preceding), 0) as before from d)
select doc_id, p.source, size, source_size, target, (whole * size + part)::bigint as taken, whole, part
from (
  select doc_id, p.source, size, source_size, target, whole, greatest(0, least(size, round(target)::bigint - whole * source_size - before))::bigint as part
  from placed p join parts q on p.source is not distinct from q.source) p
"""
