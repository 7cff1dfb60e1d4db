with b as (select cast(min(l_shipdate) as date) as lo, cast(max(l_shipdate) as date) as hi from lineitem),
k as (select lo, hi, cast(date_trunc('month', lo) + to_months(36 + k) as date) as test_start from b, range(0, 600) as t(k)),
w1 as (select *, cast(test_start + interval 1 month as date) - 1 as test_end, test_start - 64 as validation_end from k where test_start <= hi),
w2 as (select *, cast(validation_end - interval 12 month as date) + 1 as validation_start from w1),
w3 as (select *, validation_start - 64 as train_end from w2),
w as (
  select *, printf('WF%04d_', row_number() over (order by test_start)) || strftime(test_start, '%Y%m') as fold_id
  from w3 where train_end >= cast(lo + interval 24 month as date) - 1),
r as (
  select cast(l_shipdate as date) as day, l_extendedprice as y, l_quantity as a, l_discount as b, case when l_returnflag <> 'A' then l_tax end as c from lineitem),
m as (select fold_id, count(*) as train_rows, median(a) as ma, median(b) as mb, median(c) as mc from w join r on day between lo and train_end group by 1),
x as (select fold_id, y, coalesce(a, ma) as a, coalesce(b, mb) as b, coalesce(c, mc) as c from w join r on day between lo and train_end join m using (fold_id)),
s as (
  select fold_id, count(*)::double as n, avg(y) as y0, avg(a) as a0, avg(b) as b0, avg(c) as c0, stddev_pop(a) as sa, stddev_pop(b) as sb, stddev_pop(c) as sc,
    corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc, covar_pop(a, y) / stddev_pop(a) as ya, covar_pop(b, y) / stddev_pop(b) as yb, covar_pop(c, y) / stddev_pop(c) as yc
  from x group by 1),
-- (n R + 1) w = n r of three standardized features, by determinants
q as (select *, 1 + 1 / n as d from s),
t as (
  select *, d * (d * d - bc * bc) - ab * (ab * d - bc * ac) + ac * (ab * bc - d * ac) as det,
    ya * (d * d - bc * bc) - ab * (yb * d - bc * yc) + ac * (yb * bc - d * yc) as da,
    d * (yb * d - bc * yc) - ya * (ab * d - bc * ac) + ac * (ab * yc - yb * ac) as db,
    d * (d * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - d * ac) as dc
  from q),
f as (select fold_id, da / det / sa as wa, db / det / sb as wb, dc / det / sc as wc, y0, a0, b0, c0 from t),
seats as (
  select fold_id, 'validation' as role, validation_start as lo, validation_end as hi from w union all select fold_id, 'test', test_start, test_end from w),
p as (
  select fold_id, role, y, y0 + wa * (coalesce(a, ma) - a0) + wb * (coalesce(b, mb) - b0) + wc * (coalesce(c, mc) - c0) as p
  from seats join r on day between lo and hi join m using (fold_id) join f using (fold_id)),
ranked as (
  select *, rank() over (partition by fold_id, role order by y) + (count(*) over (partition by fold_id, role, y) - 1) / 2 as ry,
    rank() over (partition by fold_id, role order by p) + (count(*) over (partition by fold_id, role, p) - 1) / 2 as rp
  from p),
e as (select fold_id, role, count(*) as n_rows, sqrt(avg((y - p) * (y - p))) as rmse, avg(abs(y - p)) as mae, corr(y, p) as pearson, corr(ry, rp) as spearman from ranked group by all)
select fold_id, 'ridge' as model_name, role, case when train_rows < 20 or coalesce(n_rows, 0) < 1 then 'skipped' else 'success' end as status,
  case when train_rows < 20 then 'insufficient_train_rows=' || train_rows || '<min_train_rows=20' when coalesce(n_rows, 0) < 1 then 'insufficient_eval_rows=0<min_eval_rows=1' else '' end as notes,
  train_rows, coalesce(n_rows, 0) as n_rows, round(rmse, 3) as rmse, round(mae, 3) as mae, round(pearson, 6) as pearson, round(spearman, 6) as spearman
from seats join m using (fold_id) left join e using (fold_id, role)
