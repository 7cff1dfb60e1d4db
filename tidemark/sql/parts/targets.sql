tg0 as (
  select lineage, ll.l_partkey::varchar as ticker, event_type <> 'view' as available,
         case when l_tax >= 0.07 then 'RED' when l_tax >= 0.04 then 'YELLOW' else 'GREEN' end as tflag,
         strftime(l_shipdate, '%Y-%m-%d') as entry, strftime(l_shipdate + to_days(l_quantity::int - 10), '%Y-%m-%d') as left_on,
         case when l_tax > 0 then l_discount - 0.05 end as y
  from ll join ev on ll.o_orderkey = ev.o_orderkey),
tg as (
  select tg0.* from tg0 join grades on tflag = flag
  qualify row_number() over (partition by lineage order by place, entry, ticker, available, left_on, y nulls first) = 1),
ds as (
  select panel_row_id as model_row_id, ticker, entry as target_entry_date, list_filter([
    case when panel_quality_flag = 'RED' then 'panel_not_eligible;bad_panel_quality=RED' end,
    case when not coalesce(available, false) then 'target_not_available' end,
    case when coalesce(tflag, 'RED') = 'RED' then 'bad_target_quality=' || coalesce(tflag, 'MISSING') end,
    case when y is null then 'missing_primary_label_forward_63d_sector_adjusted_return' end,
    case when feature_asof_date is null then 'missing_or_invalid_feature_asof_date' end,
    case when entry is null then 'missing_or_invalid_target_entry_date' end,
    case when left_on is null then 'missing_or_invalid_target_exit_date' end,
    case when entry < feature_asof_date then 'target_entry_before_feature_asof' end], lambda x: x is not null) as reds,
    coalesce(left_on <= entry, false) as late
  from pf left join tg on panel_row_id = lineage)
