with b as (select cast(min(l_shipdate) as date) as lo, cast(max(l_shipdate) as date) as hi from lineitem),
k as (select lo, hi, cast(date_trunc('month', lo) + to_months(36 + k) as date) as test_start from b, range(0, 600) as t(k)),
w1 as (select *, cast(test_start + interval 1 month as date) - 1 as test_end, test_start - 64 as validation_end from k where test_start <= hi),
w2 as (select *, cast(validation_end - interval 12 month as date) + 1 as validation_start from w1),
w3 as (select *, validation_start - 64 as train_end from w2),
w as (
  select *, printf('WF%04d_', row_number() over (order by test_start)) || strftime(test_start, '%Y%m') as fold_id
  from w3 where train_end >= cast(lo + interval 24 month as date) - 1),
r as (
  select cast(l_shipdate as date) as day, l_extendedprice as y, l_quantity as a, l_discount as b, case when l_returnflag <> 'A' then l_tax end as c from lineitem)
select fold_id, u.feature, round(median(u.v), 6) as median
from w join r on day between lo and train_end,
  unnest([{'feature': 'l_quantity', 'v': a}, {'feature': 'l_discount', 'v': b}, {'feature': 'l_tax', 'v': c}, {'feature': 'l_extendedprice', 'v': y}]) as t(u)
group by all
