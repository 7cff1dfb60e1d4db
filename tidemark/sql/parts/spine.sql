ol as (
  select *, lpad(o_custkey::varchar, 10, '0') as cik10, lpad(o_orderkey::varchar, 18, '0') as accession_number,
         strftime(o_orderdate, '%Y-%m-%d') as day
  from orders),
od as (select *, cik10 || ':' || accession_number as acc from ol),
ll as (select *, acc || ':d' || l_linenumber as lineage from lineitem join od on l_orderkey = o_orderkey),
ev as (
  select od.*, event_type, ts, strftime(o_orderdate + to_days(day(ts)::int), '%Y-%m-%d') as av_date
  from events join od on event_id // 2 = o_orderkey),
av0 as (
  select acc, av_date, av_date || 'T' || strftime(ts, '%H:%M:%S') || 'Z' as av_time,
         case event_type when 'error' then 'RED' when 'click' then 'YELLOW' else 'GREEN' end as av_flag
  from ev),
mm0 as (
  select lineage, acc, cik10, accession_number, l_quantity, case when o_orderstatus = 'P' then '' else day end as asof0,
         case l_returnflag when 'R' then 'RED' when 'A' then 'YELLOW' else 'GREEN' end as mq, nullif(l_discount, 0) as dfm
  from ll),
fu0 as (
  select acc, strftime(l_shipdate, '%Y-%m-%d') as asof0, l_extendedprice as revenue,
         case l_returnflag when 'R' then 'RED' when 'A' then 'YELLOW' else 'GREEN' end as fq
  from ll where l_linestatus = 'F'),
te0 as (
  select lineage, acc, day as asof0, lang, case when n_chars < 200 then 'RED' when n_chars < 1000 then 'YELLOW' else 'GREEN' end as tq
  from ll join documents on l_orderkey = doc_id),
grades as (select * from (values ('GREEN', 0), ('YELLOW', 1), ('RED', 2)) g(flag, place)),
mm as (
  select mm0.* from mm0 join grades on mq = flag
  qualify row_number() over (partition by lineage order by place, asof0, cik10, accession_number, l_quantity, dfm nulls first) = 1),
fu as (
  select fu0.* from fu0 join grades on fq = flag qualify row_number() over (partition by acc order by place, asof0, revenue) = 1),
te as (
  select te0.* from te0 join grades on tq = flag
  qualify row_number() over (partition by lineage order by place, asof0, lang nulls first) = 1),
av as (
  select * from av0 qualify row_number() over (partition by acc order by av_date desc, av_time desc, av_flag desc) = 1),
pj as (
  select mm.lineage as panel_row_id, case when asof0 = '' then av_date else asof0 end as feature_asof_date,
         av_time as accepted_at_edgar, av_flag as timestamp_quality_flag, fq, revenue, tq, lang, mq, dfm, l_quantity
  from mm left join (select acc, fq, revenue from fu) f on mm.acc = f.acc
  left join (select lineage, tq, lang from te) t on mm.lineage = t.lineage left join av on mm.acc = av.acc),
pn as (
  select *, list_filter([
    case when feature_asof_date is null then 'missing_feature_asof_date' end,
    case when mq = 'RED' then 'bad_mismatch_quality=RED' end,
    case when coalesce(timestamp_quality_flag, 'RED') = 'RED'
         then 'bad_timestamp_quality=' || coalesce(timestamp_quality_flag, 'MISSING') end,
    case when fq = 'RED' then 'fundamental_quality_red' end,
    case when tq = 'RED' then 'text_parse_quality_red' end,
    case when dfm is null then 'missing_dfm_score_simple' end], lambda x: x is not null) as reds
  from pj),
pf as (
  select *, array_to_string(list_filter([
    case when list_contains(reds, 'missing_feature_asof_date') then 'missing_feature_asof_date' end,
    list_filter(reds, lambda x: x like 'bad_mismatch%')[1], list_filter(reds, lambda x: x like 'bad_timestamp%')[1],
    case when fq = 'RED' then 'fundamental_quality_red' when fq is null then 'fundamental_quality_missing' end,
    case when tq = 'RED' then 'text_parse_quality_red' when tq is null then 'text_parse_quality_missing' end,
    case when dfm is null then 'missing_dfm_score_simple' end], lambda x: x is not null), ';') as panel_quality_notes,
    case when len(reds) > 0 then 'RED' when fq is null or tq is null then 'YELLOW' else 'GREEN' end as panel_quality_flag
  from pn)
