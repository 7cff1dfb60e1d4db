with t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+') as words from documents),
n as (select doc_id, len(words) as tokens, list_transform(words, lambda w: ascii(md5(w)) % 9) as marks from t),
c as (
  select doc_id, tokens, len(list_filter(marks, lambda m: m = 0)) as negative, len(list_filter(marks, lambda m: m = 1)) as positive,
    len(list_filter(marks, lambda m: m = 2)) as uncertainty, len(list_filter(marks, lambda m: m = 3)) as litigious,
    len(list_filter(marks, lambda m: m = 4)) as constraining, len(list_filter(marks, lambda m: m = 5)) as strong, len(list_filter(marks, lambda m: m = 6)) as weak
  from n)
select doc_id, tokens as lm_token_count,
  negative as lm_negative_count, positive as lm_positive_count, uncertainty as lm_uncertainty_count, litigious as lm_litigious_count,
  constraining as lm_constraining_count, strong as lm_strong_modal_count, weak as lm_weak_modal_count,
  round(coalesce(negative / nullif(tokens, 0), 0), 6) as lm_negative_share, round(coalesce(positive / nullif(tokens, 0), 0), 6) as lm_positive_share,
  round(coalesce(uncertainty / nullif(tokens, 0), 0), 6) as lm_uncertainty_share, round(coalesce(litigious / nullif(tokens, 0), 0), 6) as lm_litigious_share,
  round(coalesce(constraining / nullif(tokens, 0), 0), 6) as lm_constraining_share, round(coalesce(strong / nullif(tokens, 0), 0), 6) as lm_strong_modal_share,
  round(coalesce(weak / nullif(tokens, 0), 0), 6) as lm_weak_modal_share,
  positive - negative as lm_net_tone_count, round(coalesce((positive - negative) / nullif(tokens, 0), 0), 6) as lm_net_tone_share,
  round(coalesce((positive - negative) / nullif(positive + negative, 0), 0), 6) as lm_pos_neg_balance,
  round(coalesce((strong + weak) / nullif(tokens, 0), 0), 6) as lm_modal_total_share
from c
