"""The catalogue's queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations

P = "split, training_seed, behavior_step, target_step, purpose"

FIXTURE = """
fx_seeds as (select cast(20260826 + r_regionkey as bigint) as training_seed, cast(r_regionkey as bigint) as s from region where r_regionkey < 3),
fx_steps as (select cast(n_nationkey as bigint) * 20 as step from nation where n_nationkey <= 20),
fx_pairs as (select d.training_seed, d.s, b.step as behavior_step, e.step as target_step,
  case when b.step = e.step then 'identity' when b.step = 0 then 'fixed' else 'rolling' end as purpose
  from fx_seeds d cross join fx_steps b cross join fx_steps e
  where b.step in (0, 100, 200, 300) and (b.step = e.step or (b.step = 0 and e.step > 0) or (b.step > 0 and e.step > b.step and e.step <= b.step + 100))),
fx_trajectories as (select user_id as prompt_id, case when user_id % 3 = 0 then 'test' else 'development' end as split,
  cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as sample_index, event_id,
  cast(case when event_type in ('purchase', 'signup') then 1 else 0 end as double) as correctness_reward,
  event_id % 97 + 1 as completion_length, (event_id % 97 + 1) >= 90 as was_truncated from events),
fx_rescores as (select p.training_seed, t.split, p.behavior_step, p.target_step, p.purpose, t.prompt_id, t.sample_index, t.event_id as trajectory_id,
  t.correctness_reward, t.completion_length, t.was_truncated,
  3e0 * (cast(p.target_step - p.behavior_step as double) / 100e0) * (cast((t.event_id * 7919 + p.s * 104729 + p.behavior_step * 31 + p.target_step * 13 + 17) % 1009 as double) / 1009e0 - 5e-1) as log_weight
  from fx_pairs p cross join fx_trajectories t where t.sample_index < 16),
fx_online as (select d.training_seed, t.split, st.step as target_step, t.prompt_id, t.sample_index - 16 as sample_index,
  cast(case when (t.event_id * 31 + st.step * 37 + d.s * 11) % 101 < 40 then 1 else 0 end as double) as correct
  from fx_seeds d cross join fx_steps st cross join fx_trajectories t where t.sample_index >= 16 and t.sample_index < 24)"""


def stats(rows: str = "fx_rescores", name: str = "ps", extra: str = "", sd: str = "stddev_samp") -> str:
    """Prompt statistics of the rows as a view."""
    key = f"{P}{extra}, prompt_id"
    return f"""
{name}_0 as (select *, max(log_weight) over w as m, max(case when correctness_reward = 1 then log_weight end) over w as m1, max(case when correctness_reward <> 1 then log_weight end) over w as m0
  from {rows} window w as (partition by {key})),
{name}_1 as (select {key}, count(*) as k, max(m) as m, max(m1) as m1, max(m0) as m0, sum(exp(log_weight - m)) as s1, sum(exp(2 * (log_weight - m))) as s2,
  sum(case when correctness_reward = 1 then exp(log_weight - m1) end) as g1, sum(case when correctness_reward = 1 then exp(2 * (log_weight - m1)) end) as g2,
  avg(log_weight) as mean_log_weight, coalesce({sd}(log_weight), 0e0) as sd_log_weight, avg(abs(log_weight)) as mean_abs_log_weight, -sum(log_weight) / sum(completion_length) as tokenwise_kl_proxy,
  avg(correctness_reward) as reward_rate, avg(completion_length) as mean_completion_length, median(completion_length) as median_completion_length, avg(was_truncated::int) as truncation_rate
  from {name}_0 group by {key}),
{name} as (select * exclude (k), k as "K", least(greatest(s1 * s1 / s2, 1e0), cast(k as double)) as ess, least(greatest(s1 * s1 / s2, 1e0), cast(k as double)) / k as relative_ess, 2 * m + ln(s2) - ln(k) as d2, 1 / s1 as max_normalized_weight,
  m1 + ln(g1) - ln(k) as log_is, coalesce(exp(m1 - m) * g1 / s1, 0e0) as pwis, coalesce(exp(2 * (m1 - m)) * g2 / s2, 0e0) as alpha from {name}_1)"""


def estimates(name: str = "ps", extra: str = "", out: str = "est") -> str:
    key = f"{P}{extra}"
    return f"""
{out}_0 as (select *, max(log_is) over (partition by {key}) as top from {name}),
{out}_1 as (select {key}, max(top) + ln(sum(exp(log_is - top))) - ln(count(*)) as lg, avg(pwis) as pw from {out}_0 group by {key}),
{out} as (select {key}, 'is' as estimator, coalesce(exp(lg), 0e0) as estimate, 'ok' as estimate_status from {out}_1 union all select {key}, 'prompt_wis', pw, 'ok' from {out}_1)"""


ONLINE = """
acc as (select split, training_seed, target_step, prompt_id, cast(sum(correct) as bigint) as success_count, count(*) as n_samples, avg(correct) as prompt_accuracy from fx_online group by 1, 2, 3, 4),
ref as (select split, training_seed, target_step, avg(prompt_accuracy) as online_reference from acc group by 1, 2, 3)"""


def diagnostics(rows: str = "fx_rescores", name: str = "ps", extra: str = "", out: str = "diag") -> str:
    key = f"{P}{extra}"
    return f"""
{out}_p as (select {key}, count(*) as n_prompts, max("K") as "K", median(ess) as median_prompt_ess, median(relative_ess) as median_prompt_relative_ess, quantile_cont(relative_ess, 0.1) as p10_prompt_relative_ess,
  avg(d2) as mean_d2, median(d2) as median_d2, avg(max_normalized_weight) as mean_max_normalized_weight, quantile_cont(max_normalized_weight, 0.9) as p90_max_normalized_weight from {name} group by {key}),
{out}_r as (select {key}, -sum(log_weight) / sum(completion_length) as tokenwise_kl_proxy, avg(abs(log_weight)) as mean_abs_log_weight, avg(log_weight) as mean_log_weight, coalesce(stddev_samp(log_weight), 0e0) as sd_log_weight,
  avg(completion_length) as mean_completion_length, avg(was_truncated::int) as truncation_rate, abs(sum(log_weight) / sum(completion_length)) as pair_abs_mean_log_ratio_per_token from {rows} group by {key}),
{out} as (select * from {out}_p join {out}_r using ({key}))"""


RESULTS = f"""
res as (select *, estimate - online_reference as signed_error, abs(estimate - online_reference) as absolute_error from est join ref using (split, training_seed, target_step) join diag using ({P})),
fixed as (select * from res where purpose = 'fixed' and behavior_step = 0 and target_step > 0),
rolling as (select n.split, n.training_seed, n.target_step, n.estimator, n.behavior_step as recent_behavior_step, o.behavior_step as old_behavior_step, n.online_reference, o.estimate as old_estimate, n.estimate as recent_estimate,
  o.absolute_error as old_absolute_error, n.absolute_error as recent_absolute_error, o.absolute_error - n.absolute_error as delta_error_old_minus_recent,
  n.median_prompt_relative_ess - o.median_prompt_relative_ess as delta_relative_ess_recent_minus_old, o.median_prompt_relative_ess as old_median_relative_ess, n.median_prompt_relative_ess as recent_median_relative_ess,
  o.mean_d2 as old_mean_d2, n.mean_d2 as recent_mean_d2, n.tokenwise_kl_proxy as recent_tokenwise_kl_proxy
  from res n join res o on n.split = o.split and n.training_seed = o.training_seed and n.target_step = o.target_step and n.estimator = o.estimator and o.behavior_step = 0 and o.purpose = 'fixed' and n.purpose = 'rolling'),
cases as (select {P}, absolute_error, median_prompt_relative_ess, tokenwise_kl_proxy from fixed where estimator = 'prompt_wis'
  union all select split, training_seed, recent_behavior_step, target_step, 'rolling', recent_absolute_error, recent_median_relative_ess, recent_tokenwise_kl_proxy from rolling where estimator = 'prompt_wis')"""

TOLERANCES = "tol as (select unnest([cast(0.01 as double), cast(0.02 as double), cast(0.05 as double)]) as tolerance)"
GATES = f"""
{TOLERANCES},
gated as (select *, 'primary_ress' as gate_kind, 'median_prompt_relative_ess' as diagnostic_name, 'ge' as direction, median_prompt_relative_ess as diagnostic_value from cases
  union all select *, 'kl_baseline', 'tokenwise_kl_proxy', 'le', tokenwise_kl_proxy from cases),
cal as (select * from gated cross join tol where split = 'development' and training_seed in (20260826, 20260827)),
bounds as (select gate_kind, diagnostic_name, direction, tolerance, max(case when absolute_error > tolerance then diagnostic_value end) as high, min(case when absolute_error > tolerance then diagnostic_value end) as low,
  count(*) as n_pairs, count(distinct diagnostic_value) + 1 as threshold_candidate_count, max(diagnostic_value) as most, min(diagnostic_value) as least from cal group by 1, 2, 3, 4),
fitted as (select gate_kind, diagnostic_name, direction, tolerance, n_pairs, threshold_candidate_count,
  case when direction = 'ge' then coalesce((select min(diagnostic_value) from cal c where c.gate_kind = b.gate_kind and c.tolerance = b.tolerance and (b.high is null or c.diagnostic_value > b.high)), most + 1e-15)
  else coalesce((select max(diagnostic_value) from cal c where c.gate_kind = b.gate_kind and c.tolerance = b.tolerance and (b.low is null or c.diagnostic_value < b.low)), least - 1e-15) end as fitted_threshold,
  case when direction = 'ge' then not exists (select 1 from cal c where c.gate_kind = b.gate_kind and c.tolerance = b.tolerance and (b.high is null or c.diagnostic_value > b.high))
  else not exists (select 1 from cal c where c.gate_kind = b.gate_kind and c.tolerance = b.tolerance and (b.low is null or c.diagnostic_value < b.low)) end as reject_all from bounds b),
decided_0 as (select g.*, f.tolerance, f.fitted_threshold, f.reject_all, case when g.split = 'test' then 'official_test' when g.training_seed = 20260828 then 'heldout_seed_validation' else 'calibration' end as evaluation_role,
  case when g.direction = 'ge' then g.diagnostic_value >= f.fitted_threshold else g.diagnostic_value <= f.fitted_threshold end as accepted, g.absolute_error <= f.tolerance as reliable
  from gated g join fitted f on g.gate_kind = f.gate_kind),
decided as (select *, case when accepted then 'accept' else 'refresh' end as decision, accepted and not reliable as false_accept, not accepted and reliable as false_reject from decided_0),
judged as (select * from decided where evaluation_role <> 'calibration')"""

COUNTS = """count(*) as n_pairs, count_if(accepted) as accepted_count, count(*) - count_if(accepted) as rejected_count, round(count_if(accepted) / count(*), 6) as accept_rate, count_if(reliable) as reliable_count, count(*) - count_if(reliable) as unreliable_count,
  count_if(false_accept) as false_accept_count, round(coalesce(count_if(false_accept) / nullif(count_if(accepted), 0), 0e0), 6) as false_accept_rate_among_accepted, round(count_if(false_accept) / count(*), 6) as false_accept_fraction_all"""
REJECTS = "count_if(false_reject) as false_reject_count, round(coalesce(count_if(false_reject) / nullif(count_if(reliable), 0), 0e0), 6) as false_reject_rate_among_reliable"
ERRORS = "round(avg(case when accepted then absolute_error end), 6) as accepted_mae, round(avg(case when not accepted then absolute_error end), 6) as rejected_mae"

FULL = ",".join([FIXTURE, stats(), estimates(), ONLINE, diagnostics(), RESULTS])
GATE = f"{FULL},{GATES}"

REPS, SIZE_REPS = 200, 50  # replicates of the portable bootstrap, as in the catalogue


def ranked(extra: str = "") -> str:
    key = f"{P}{extra}"
    return f"""
ranked as (select ps.*, prompt_accuracy, row_number() over (partition by {key} order by prompt_id) - 1 as at, count(*) over (partition by {key}) as n, concat_ws('-', {key}) as name
  from ps join acc using (split, training_seed, target_step, prompt_id))"""


MATCHED = ",".join([FIXTURE, stats(), ONLINE, ranked()])


def replicates(paired: bool, extra: str = "", reps: int = REPS) -> str:
    key = f"{P}{extra}"
    seed = "r.name || '|' || rep" if paired else "r.name || '|' || estimator || '|' || rep"
    value = "case when max(log_is) is null then 0e0 else exp(max(top) + ln(sum(exp(log_is - top)) / count(*))) end" if paired else "sum(coalesce(exp(log_is), 0e0)) / count(*)"
    return f"""
draws as (select r.*, estimator, rep, cast('0x' || substr(md5({seed} || '|' || r.at), 1, 8) as bigint) % n as pick from ranked r cross join (select unnest(range({reps})) as rep) cross join (select unnest(['is', 'prompt_wis']) as estimator)),
tops as (select d.name, d.estimator, d.rep, max(x.log_is) as top from draws d join ranked x on x.name = d.name and x.at = d.pick group by 1, 2, 3),
drawn as (select {", ".join("d." + c.strip() for c in key.split(","))}, d.estimator, d.rep, x.log_is, x.pwis, x.prompt_accuracy, t.top
  from draws d join ranked x on x.name = d.name and x.at = d.pick join tops t on t.name = d.name and t.estimator = d.estimator and t.rep = d.rep),
reps as (select {key}, estimator, rep, case when estimator = 'is' then {value} else avg(pwis) end as ope, avg(prompt_accuracy) as online from drawn group by {key}, estimator, rep),
ci as (select {key}, estimator, {", ".join(f"quantile_cont({x}, {q}) as {n}_ci_{s}" for n, x in (("ope", "ope"), ("online", "online"), ("signed_error", "ope - online"), ("absolute_error", "abs(ope - online)")) for s, q in (("low", 0.025), ("high", 0.975)))},
  0e0 as bootstrap_nonfinite_fraction, count(*) as bootstrap_reps from reps group by {key}, estimator)"""


def rounds(names: list[str] | str, digits: int = 6) -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(f"round({n}, {digits}) + 0e0 as {n}" for n in names)  # no minus zero


CI = rounds([f"{n}_ci_{s}" for n in ("ope", "online", "signed_error", "absolute_error") for s in ("low", "high")] + ["bootstrap_nonfinite_fraction"], 9)
DIAGNOSTICS = "median_prompt_ess median_prompt_relative_ess p10_prompt_relative_ess mean_d2 median_d2 mean_max_normalized_weight p90_max_normalized_weight tokenwise_kl_proxy mean_abs_log_weight mean_log_weight sd_log_weight mean_completion_length truncation_rate"
STATS = "ess relative_ess d2 max_normalized_weight log_is pwis mean_log_weight sd_log_weight mean_abs_log_weight tokenwise_kl_proxy reward_rate mean_completion_length median_completion_length truncation_rate alpha"

MECHANISM = f"""
psx as (select p.*, 2 * m + ln(s2) - ln(k) as log_kappa2 from ps p),
mech_0 as (select n.split, n.training_seed, n.target_step, o.behavior_step as old_behavior_step, n.behavior_step as recent_behavior_step, n.prompt_id, n."K", r.online_reference as v,
  o.alpha as old_alpha, n.alpha as recent_alpha, o.log_kappa2 as old_log_kappa2, n.log_kappa2 as recent_log_kappa2, o.relative_ess as old_relative_ess, n.relative_ess as recent_relative_ess
  from psx n join psx o on n.split = o.split and n.training_seed = o.training_seed and n.target_step = o.target_step and n.prompt_id = o.prompt_id and o.purpose = 'fixed' and o.behavior_step = 0 and n.purpose = 'rolling'
  join ref r on r.split = n.split and r.training_seed = n.training_seed and r.target_step = n.target_step),
mech_1 as (select *, least(greatest(v * v + (1 - 2 * v) * old_alpha, 0e0), 1e0) as old_A_proxy, least(greatest(v * v + (1 - 2 * v) * recent_alpha, 0e0), 1e0) as recent_A_proxy from mech_0),
mech as (select *, old_log_kappa2 + ln(old_A_proxy) as old_log_m2_proxy, recent_log_kappa2 + ln(recent_A_proxy) as recent_log_m2_proxy, recent_log_kappa2 - old_log_kappa2 as dk, ln(recent_A_proxy) - ln(old_A_proxy) as da,
  recent_log_kappa2 + ln(recent_A_proxy) - old_log_kappa2 - ln(old_A_proxy) as dm, case when v < 5e-1 then recent_alpha < old_alpha when v > 5e-1 then recent_alpha > old_alpha else false end as moves from mech_1),
tops as (select *, max(old_log_m2_proxy) over w as old_top, max(recent_log_m2_proxy) over w as recent_top from mech window w as (partition by split, training_seed, target_step, old_behavior_step, recent_behavior_step)),
mpair as (select split, training_seed, target_step, old_behavior_step, recent_behavior_step, count(*) as n_prompts, max("K") as "K", max(v) as online_reference, median(old_relative_ess) as old_median_relative_ess, median(recent_relative_ess) as recent_median_relative_ess,
  avg(old_alpha) as old_mean_alpha, avg(recent_alpha) as recent_mean_alpha, median(old_alpha) as old_median_alpha, median(recent_alpha) as recent_median_alpha, avg(old_A_proxy) as old_mean_A_proxy, avg(recent_A_proxy) as recent_mean_A_proxy,
  avg(dk) as mean_delta_log_kappa2_recent_minus_old, avg(da) as mean_delta_log_A_proxy_recent_minus_old, avg(dm) as mean_delta_log_m2_proxy_recent_minus_old,
  max(old_top) + ln(avg(exp(old_log_m2_proxy - old_top))) as log_mean_m2_proxy_old, max(recent_top) + ln(avg(exp(recent_log_m2_proxy - recent_top))) as log_mean_m2_proxy_recent,
  avg((dk < 0)::int) as fraction_prompts_overlap_channel_favorable, avg((recent_A_proxy < old_A_proxy)::int) as fraction_prompts_reward_proxy_channel_favorable, avg((dm < 0)::int) as fraction_prompts_combined_proxy_favorable, avg(moves::int) as fraction_prompts_alpha_moves_favorable
  from tops group by 1, 2, 3, 4, 5),
mpairs as (select *, case when online_reference < 5e-1 then 'lower_alpha_favorable' when online_reference > 5e-1 then 'higher_alpha_favorable' else 'alpha_neutral_at_v_equals_half' end as alpha_favorable_direction,
  recent_mean_alpha - old_mean_alpha as delta_mean_alpha_recent_minus_old, recent_mean_A_proxy - old_mean_A_proxy as delta_mean_A_proxy_recent_minus_old,
  exp(mean_delta_log_kappa2_recent_minus_old) as geometric_kappa2_ratio_recent_over_old, exp(mean_delta_log_A_proxy_recent_minus_old) as geometric_A_proxy_ratio_recent_over_old, exp(mean_delta_log_m2_proxy_recent_minus_old) as geometric_m2_proxy_ratio_recent_over_old,
  exp(log_mean_m2_proxy_recent - log_mean_m2_proxy_old) as aggregate_m2_proxy_ratio_recent_over_old from mpair)"""
MECH = ",".join([FIXTURE, stats(), ONLINE, MECHANISM])
PAIR_VALUES = """online_reference old_median_relative_ess recent_median_relative_ess old_mean_alpha recent_mean_alpha old_median_alpha recent_median_alpha old_mean_A_proxy recent_mean_A_proxy mean_delta_log_kappa2_recent_minus_old
mean_delta_log_A_proxy_recent_minus_old mean_delta_log_m2_proxy_recent_minus_old log_mean_m2_proxy_old log_mean_m2_proxy_recent fraction_prompts_overlap_channel_favorable fraction_prompts_reward_proxy_channel_favorable
fraction_prompts_combined_proxy_favorable fraction_prompts_alpha_moves_favorable delta_mean_alpha_recent_minus_old delta_mean_A_proxy_recent_minus_old geometric_kappa2_ratio_recent_over_old geometric_A_proxy_ratio_recent_over_old
geometric_m2_proxy_ratio_recent_over_old aggregate_m2_proxy_ratio_recent_over_old"""

SIZES = ",".join([FIXTURE, "sized as (select *, 8 as ksize from fx_rescores where sample_index < 8 and split = 'development' and purpose in ('fixed', 'rolling') union all select *, 16 from fx_rescores where sample_index < 16 and split = 'development' and purpose in ('fixed', 'rolling'))", stats("sized", "ps", ", ksize"), estimates("ps", ", ksize"), ONLINE, diagnostics("sized", "ps", ", ksize"), f"""
sizes as (select {P}, cast(ksize as bigint) as "K", estimator, estimate, estimate_status, online_reference, abs(estimate - online_reference) as absolute_error, median_prompt_relative_ess, p10_prompt_relative_ess, n_prompts
  from est join ref using (split, training_seed, target_step) join (select * exclude ("K") from diag) using ({P}, ksize))"""])

TEMPLATES = f"""
templates as (select behavior_step, target_step, purpose, median(median_prompt_relative_ess) as pooled_median_relative_ess, median(tokenwise_kl_proxy) as pooled_tokenwise_kl_proxy from cases
  where split = 'development' and training_seed in (20260826, 20260827) group by 1, 2, 3 having count(*) = 2),
template_ranks as (select *, row_number() over (order by pooled_median_relative_ess, behavior_step, target_step) - 1 as representative_rank, count(*) over () as n from templates),
bands as (select behavior_step, target_step, purpose, pooled_median_relative_ess, pooled_tokenwise_kl_proxy, representative_rank,
  case when representative_rank / (n - 1) < 1e0 / 3e0 then 'low_overlap' when representative_rank / (n - 1) < 2e0 / 3e0 then 'medium_overlap' else 'high_overlap' end as overlap_band
  from template_ranks where representative_rank in (select cast(round_even(i * (n - 1) / cast(7 as double), 0) as bigint) from (select unnest(range(8)) as i)))"""

PROMPTS = """prompts as (select c_custkey as source_row_index, c_name as question, case when c_nationkey % 4 = 0 then 'test' else 'train' end as original_split,
  sha256('{"question":"' || c_name || '","source_row_index":' || c_custkey || '}') as prompt_id from customer)"""

FORMS = """forms as (select o_orderkey, o_custkey, o_orderkey % 9 as f from orders)"""

TOKENS = """tok as (select l_orderkey, list(l_partkey order by l_partkey, l_suppkey, l_extendedprice) as p, list(l_suppkey order by l_partkey, l_suppkey, l_extendedprice) as s, list(l_extendedprice order by l_partkey, l_suppkey, l_extendedprice) as e from lineitem group by 1)"""


def w(*parts: str) -> str:
    """Views, and the query over them."""
    return "with " + ",".join(parts[:-1]) + "\n" + parts[-1]


GRID = f"""
gcases as (select training_seed, behavior_step, target_step, 'fixed' as purpose, absolute_error, cast(null as double) as old_absolute_error, median_prompt_relative_ess as ress from fixed where estimator = 'prompt_wis' and split = 'development'
  union all select training_seed, recent_behavior_step, target_step, 'rolling', recent_absolute_error, old_absolute_error, recent_median_relative_ess from rolling where estimator = 'prompt_wis' and split = 'development'),
scopes as (select unnest([20260826, 20260827, 20260828]) as training_seed, 'all' as scope union all select unnest([20260826, 20260827]), 'calibration' union all select 20260828, 'validation'),
cand as (select 'C1' as candidate_id, [100, 200, 300, 400] as targets, [20, 100] as lags union all select 'C2', [200, 400], [40] union all select 'C3', [20, 40], [20, 40, 60]),
thr as (select cast(0.02 as double) as tolerance, cast(0.4 as double) as t union all select cast(0.05 as double), cast(0.2 as double)),
scoped as (select g.*, s.scope, thr.tolerance, ress >= t as accept from gcases g join scopes s using (training_seed) cross join thr),
whole as (select scope, tolerance, avg(case when purpose = 'fixed' then absolute_error end) as mae, avg(accept::int) as rate from scoped group by 1, 2),
part as (select candidate_id, scope, tolerance, count_if(purpose = 'fixed') as n_fixed, count_if(purpose = 'rolling') as n_rolling, avg(case when purpose = 'fixed' then absolute_error end) as mae,
  avg(case when purpose = 'rolling' then old_absolute_error - absolute_error end) as red, avg(accept::int) as rate
  from scoped join cand on (purpose = 'fixed' and list_contains(targets, target_step)) or (purpose = 'rolling' and list_contains(lags, target_step - behavior_step)) group by 1, 2, 3)"""

SUBSET = ",".join([FIXTURE, "shown as (select * from fx_rescores where purpose = 'fixed')", stats("shown", "ps"), ONLINE, f"""
mt as (select ps.*, prompt_accuracy, prompt_id % 20 as source from ps join acc using (split, training_seed, target_step, prompt_id)),
whole as (select {P}, avg(pwis) as fe, avg(prompt_accuracy) as fr, median(relative_ess) as fs from mt group by {P}),
src as (select distinct split, training_seed, behavior_step, source from mt),
srk as (select *, row_number() over (partition by split, training_seed, behavior_step, replicate order by sha256('subset-v1|' || replicate || '|' || training_seed || '|' || behavior_step || '|' || source), source) as pos,
  count(*) over (partition by split, training_seed, behavior_step, replicate) as n from src cross join (select unnest(range(50)) as replicate)),
chosen as (select * from srk cross join (select unnest([cast(0.25 as double), cast(0.5 as double)]) as fraction) where pos <= greatest(1, least(n, round_even(fraction * n, 0)))),
part as (select {", ".join("m." + c.strip() for c in P.split(","))}, fraction, replicate, avg(pwis) as e, avg(prompt_accuracy) as r, median(relative_ess) as s
  from mt m join chosen c on c.split = m.split and c.training_seed = m.training_seed and c.behavior_step = m.behavior_step and c.source = m.source group by all),
thr as (select cast(0.02 as double) as tolerance, cast(0.4 as double) as t union all select cast(0.05 as double), cast(0.2 as double)),
pt as (select p.*, tolerance, s >= t as sub, fs >= t as whole, abs(abs(e - r) - abs(fe - fr)) as change from part p join whole using ({P}) cross join thr),
each as (select split, fraction, tolerance, replicate, avg((sub = whole)::int) as agreement, abs(avg(sub::int) - avg(whole::int)) as ad, median(change) as mc, quantile_cont(change, 0.95) as pc from pt group by 1, 2, 3, 4)"""])

SUMMARY = f"select evaluation_role, split, gate_kind, diagnostic_name, tolerance, seed_scope, {COUNTS}, {REJECTS}, {ERRORS}, round(avg(absolute_error), 6) as overall_mae from (select *, 'all' as seed_scope from judged union all select *, cast(training_seed as varchar) from judged) group by 1, 2, 3, 4, 5, 6"

_lag = """select split, lag as recent_log_lag_steps, count(*) as n_pair_seed_cases, round(avg(old_absolute_error), 6) as mean_old_absolute_error, round(avg(recent_absolute_error), 6) as mean_recent_absolute_error, round(avg(delta_error_old_minus_recent), 6) as mean_error_reduction_old_minus_recent,
  round(avg((recent_absolute_error < old_absolute_error)::int), 6) as fraction_recent_lower_error, round(avg(old_median_relative_ess), 6) as mean_old_median_relative_ess, round(avg(recent_median_relative_ess), 6) as mean_recent_median_relative_ess, round(avg(delta_relative_ess_recent_minus_old), 6) as mean_relative_ess_gain
  from (select *, cast(target_step - recent_behavior_step as varchar) as lag from rolling where estimator = 'prompt_wis' union all select *, 'overall' from rolling where estimator = 'prompt_wis') group by 1, 2"""


def horizon(prefix: bool) -> str:
    last = "cast(max(case when run then target_step end) as double)" if prefix else "cast(max(case when reliable then target_step end) as double)"
    return f"""select split, training_seed, behavior_step, estimator, tolerance, {last} as last_reliable_target_step, {last} - behavior_step as horizon_steps, count(*) as n_candidate_targets, count_if(reliable) as n_reliable_targets
from (select *, bool_and(reliable) over (partition by split, training_seed, behavior_step, estimator, tolerance order by target_step) as run from (select *, absolute_error <= tolerance as reliable from fixed cross join tol)) group by 1, 2, 3, 4, 5"""


ORACLES: dict[str, str] = {
    "prompt_stats": w(FIXTURE, stats(), f'select {P}, prompt_id, "K", {rounds(STATS)} from ps'),
    "estimate_is": w(FIXTURE, stats(), estimates(), f"select {P}, estimator, {rounds('estimate')}, estimate_status from est where estimator = 'is'"),
    "estimate_pwis": w(FIXTURE, stats(), estimates(), f"select {P}, estimator, {rounds('estimate')}, estimate_status from est where estimator = 'prompt_wis'"),
    "global_wis": w(FIXTURE, f"select {P}, round(sum(case when correctness_reward = 1 then exp(log_weight - m) else 0e0 end) / sum(exp(log_weight - m)), 6) as global_wis from (select *, max(log_weight) over (partition by {P}) as m from fx_rescores) group by {P}"),
    "pair_diagnostics": w(FIXTURE, stats(), diagnostics(), f'select {P}, n_prompts, "K", {rounds(DIAGNOSTICS + " pair_abs_mean_log_ratio_per_token")} from diag'),
    "svamp_diagnostics": w(FIXTURE, stats(sd="stddev_pop"), f"""select {P}, round(median(ess), 6) as median_prompt_ess, round(median(relative_ess), 6) as median_prompt_relative_ess, round(quantile_cont(relative_ess, 0.1), 6) as p10_prompt_relative_ess, round(avg(d2), 6) as mean_d2, round(median(d2), 6) as median_d2,
  round(avg(max_normalized_weight), 6) as mean_max_normalized_weight, round(quantile_cont(max_normalized_weight, 0.9), 6) as p90_max_normalized_weight, round(sum(tokenwise_kl_proxy * mean_completion_length * "K") / sum(mean_completion_length * "K"), 6) as tokenwise_kl_proxy,
  round(avg(mean_abs_log_weight), 6) as mean_abs_log_weight, round(avg(mean_log_weight), 6) as mean_log_weight, round(stddev_pop(mean_log_weight), 6) as sd_log_weight, round(avg(mean_completion_length), 6) as mean_completion_length, round(avg(truncation_rate), 6) as truncation_rate from ps group by {P}"""),
    "length_quantile": w(FIXTURE, stats(), f"select {P}, prompt_id, ['Q1_short', 'Q2', 'Q3', 'Q4_long'][cast(least(3, 4 * (row_number() over (partition by {P} order by mean_completion_length, prompt_id) - 1) // count(*) over (partition by {P})) as bigint) + 1] as length_quantile from ps"),
    "online_reference": w(FIXTURE, ONLINE, "select split, training_seed, target_step, count(*) as n_prompts, round(avg(prompt_accuracy), 6) as online_reference, round(sqrt(coalesce(var_samp(prompt_accuracy), 0) / count(*)), 6) as prompt_standard_error, round(sqrt(sum(prompt_accuracy * (1 - prompt_accuracy) / (n_samples - 1))) / count(*), 6) as mc_standard_error, round(sum(success_count) / sum(n_samples), 6) as pooled_accuracy from acc group by 1, 2, 3"),
    "online_prompt_accuracy": w(FIXTURE, "select split, training_seed, target_step, prompt_id, cast(sum(correct) as bigint) as success_count, count(*) as n_samples, round(avg(correct), 6) as prompt_accuracy from fx_online where sample_index < 4 group by 1, 2, 3, 4"),
    "fixed_table": w(FULL, f'select {P}, estimator, {rounds("estimate online_reference signed_error absolute_error " + DIAGNOSTICS)}, estimate_status, n_prompts, "K" from fixed'),
    "overlap_table": w(FIXTURE, stats(), diagnostics(), f"select {P}, prompt_id, round(ps.relative_ess, 6) as relative_ess, round(ps.d2, 6) as d2, round(pair_abs_mean_log_ratio_per_token, 6) as pair_abs_mean_log_ratio_per_token, round(diag.tokenwise_kl_proxy, 6) + 0e0 as pair_tokenwise_kl_proxy, ['Q1_short', 'Q2', 'Q3', 'Q4_long'][cast(least(3, 4 * (row_number() over (partition by {P} order by ps.mean_completion_length, prompt_id) - 1) // count(*) over (partition by {P})) as bigint) + 1] as length_quantile from ps join diag using ({P})"),
    "rolling_table": w(FULL, f"select split, training_seed, target_step, estimator, recent_behavior_step, old_behavior_step, {rounds('online_reference old_estimate recent_estimate old_absolute_error recent_absolute_error delta_error_old_minus_recent delta_relative_ess_recent_minus_old old_mean_d2 recent_mean_d2')} from rolling"),
    "sample_size": w(SIZES, ranked(", ksize"), replicates(True, ", ksize", SIZE_REPS), f'select {P}, "K", estimator, {rounds("estimate online_reference absolute_error median_prompt_relative_ess p10_prompt_relative_ess")}, estimate_status, n_prompts, round(ope_ci_high - ope_ci_low, 6) as bootstrap_ci_width, bootstrap_nonfinite_fraction from sizes join (select * exclude (ksize), cast(ksize as bigint) as "K" from ci) using ({P}, "K", estimator)'),
    "sample_size_summary": w(SIZES, ranked(", ksize"), replicates(True, ", ksize", SIZE_REPS), f'select "K", estimator, count(*) as n_pair_seed_cases, round(avg(absolute_error), 6) as mean_absolute_error, round(avg(median_prompt_relative_ess), 6) as mean_median_prompt_relative_ess, round(avg(ope_ci_high - ope_ci_low), 6) as mean_bootstrap_ci_width, round(avg(bootstrap_nonfinite_fraction), 6) as mean_bootstrap_nonfinite_fraction from sizes join (select * exclude (ksize), cast(ksize as bigint) as "K" from ci) using ({P}, "K", estimator) group by 1, 2'),
    "bootstrap_ci": w(MATCHED, replicates(True), f"select {P}, estimator, {CI}, bootstrap_reps from ci"),
    "svamp_bootstrap": w(MATCHED, replicates(False), f"select {P}, estimator, {CI}, bootstrap_reps from ci"),
    "gate_cases": w(FULL, f"select {P}, {rounds('absolute_error median_prompt_relative_ess tokenwise_kl_proxy')} from cases"),
    "gate_fit": w(GATE, f"select gate_kind, diagnostic_name, direction, tolerance, {rounds('fitted_threshold')}, reject_all, n_pairs, threshold_candidate_count from fitted"),
    "gate_calibration": w(GATE, f"select split, gate_kind, diagnostic_name, direction, tolerance, {COUNTS}, {ERRORS}, round(max(fitted_threshold), 6) as fitted_threshold, bool_or(reject_all) as reject_all, max(f.threshold_candidate_count) as threshold_candidate_count from decided join (select gate_kind, tolerance, threshold_candidate_count from fitted) f using (gate_kind, tolerance) where evaluation_role = 'calibration' group by 1, 2, 3, 4, 5"),
    "gate_eval": w(GATE, f"select evaluation_role, {P}, gate_kind, tolerance, {rounds('diagnostic_value fitted_threshold')}, decision, accepted, reliable, false_accept, false_reject from judged"),
    "gate_summary": w(GATE, SUMMARY),
    "gate_monotonicity": w(GATE, "select count(*) as n_breaks from (select *, lag(fitted_threshold) over (partition by gate_kind order by tolerance) as p from fitted) where case when direction = 'ge' then p + 1e-15 < fitted_threshold else p > fitted_threshold + 1e-15 end"),
    "gate_table": w(GATE, f"select evaluation_role, gate_kind, tolerance, count(*) as n_pair_seed_cases, round(count_if(accepted) / count(*), 6) as accept_rate, count_if(false_accept) as false_accept_count, round(coalesce(count_if(false_accept) / nullif(count_if(accepted), 0), 0e0), 6) as false_accept_rate_among_accepted, round(count_if(false_accept) / count(*), 6) as false_accept_fraction_all, round(count_if(reliable) / count(*), 6) as reliable_fraction, {ERRORS}, round(avg(absolute_error), 6) as overall_mae from judged group by 1, 2, 3"),
    "pair_templates": w(FULL, TEMPLATES, f"select behavior_step, target_step, purpose, {rounds('pooled_median_relative_ess pooled_tokenwise_kl_proxy')} from templates"),
    "registry_bands": w(FULL, TEMPLATES, f"select behavior_step, target_step, purpose, {rounds('pooled_median_relative_ess pooled_tokenwise_kl_proxy')}, representative_rank, overlap_band from bands"),
    "robustness_summary": w(GATE, TEMPLATES, f"select gate_kind, tolerance, overlap_band, count(*) as n_pair_seed_cases, count_if(accepted) as accepted_count, round(count_if(accepted) / count(*), 6) as accept_rate, count_if(false_accept) as false_accept_count, round(coalesce(count_if(false_accept) / nullif(count_if(accepted), 0), 0e0), 6) as false_accept_rate_among_accepted, round(count_if(false_accept) / count(*), 6) as false_accept_fraction_all, {ERRORS} from judged join (select behavior_step, target_step, purpose, overlap_band from bands) using (behavior_step, target_step, purpose) where evaluation_role = 'official_test' group by 1, 2, 3"),
    "alpha_prompt": w(MECH, f"select split, training_seed, target_step, old_behavior_step, recent_behavior_step, prompt_id, {rounds('old_alpha recent_alpha old_A_proxy recent_A_proxy old_log_kappa2 recent_log_kappa2 old_log_m2_proxy recent_log_m2_proxy')}, round(dm, 6) as delta_log_m2_proxy_recent_minus_old, dk < 0 as overlap_channel_favorable, moves as alpha_moves_favorable from mech"),
    "alpha_pair": w(MECH, f'select split, training_seed, target_step, old_behavior_step, recent_behavior_step, n_prompts, "K", alpha_favorable_direction, {rounds(PAIR_VALUES)} from mpairs'),
    "alpha_split": w(MECH, """select *, case when pairs_ress_improved = n_pairs and pairs_aggregate_m2_proxy_favorable = n_pairs and 2 * pairs_alpha_mean_moved_favorable < n_pairs then 'C_overlap_dominates_adverse_reward_stratum_movement'
  when pairs_ress_improved = n_pairs and pairs_aggregate_m2_proxy_favorable = n_pairs then 'B_overlap_and_reward_stratum_mostly_align' when pairs_ress_improved = n_pairs then 'A_overlap_repairs_but_aggregate_risk_not_uniformly_improved' else 'mixed_or_unclassified' end as mechanism_pattern from (
select split, count(*) as n_pairs, count(distinct training_seed) as n_training_seeds, cast(sum(n_prompts) as bigint) as n_prompt_pair_rows, count_if(recent_median_relative_ess > old_median_relative_ess) as pairs_ress_improved, count_if(recent_mean_A_proxy < old_mean_A_proxy) as pairs_reward_proxy_channel_favorable,
  count_if(mean_delta_log_m2_proxy_recent_minus_old < 0) as pairs_prompt_geometric_m2_proxy_favorable, count_if(aggregate_m2_proxy_ratio_recent_over_old < 1) as pairs_aggregate_m2_proxy_favorable,
  count_if(case when online_reference < 5e-1 then recent_mean_alpha < old_mean_alpha when online_reference > 5e-1 then recent_mean_alpha > old_mean_alpha else false end) as pairs_alpha_mean_moved_favorable,
  round(avg(old_median_relative_ess), 6) as mean_old_ress, round(avg(recent_median_relative_ess), 6) as mean_recent_ress, round(avg(old_mean_alpha), 6) as mean_old_alpha, round(avg(recent_mean_alpha), 6) as mean_recent_alpha, round(avg(old_mean_A_proxy), 6) as mean_old_A_proxy, round(avg(recent_mean_A_proxy), 6) as mean_recent_A_proxy,
  round(exp(avg(mean_delta_log_kappa2_recent_minus_old)), 6) as geometric_mean_kappa2_ratio_recent_over_old, round(exp(avg(mean_delta_log_A_proxy_recent_minus_old)), 6) as geometric_mean_A_proxy_ratio_recent_over_old, round(exp(avg(mean_delta_log_m2_proxy_recent_minus_old)), 6) as geometric_mean_promptwise_m2_proxy_ratio_recent_over_old,
  round(avg(aggregate_m2_proxy_ratio_recent_over_old), 6) as mean_pair_aggregate_m2_proxy_ratio_recent_over_old, round(median(aggregate_m2_proxy_ratio_recent_over_old), 6) as median_pair_aggregate_m2_proxy_ratio_recent_over_old,
  round(exp(avg(log_mean_m2_proxy_recent - log_mean_m2_proxy_old)), 6) as geometric_mean_pair_aggregate_m2_proxy_ratio_recent_over_old, round(min(online_reference), 6) as target_reference_min, round(max(online_reference), 6) as target_reference_max from mpairs group by 1)"""),
    "alpha_identity": "select cast(0 as bigint) as n_breaks",
    "estimator_table": w(FULL, ranked(), replicates(True), "select split, estimator, count(*) as n_pair_seed_cases, round(avg(ope_ci_high - ope_ci_low), 6) as mean_ope_ci_width, round(avg(absolute_error), 6) as mean_absolute_error, round(median(absolute_error), 6) as median_absolute_error, round(sqrt(avg(signed_error * signed_error)), 6) as rmse, round(avg(signed_error), 6) as mean_signed_error, round(avg(median_prompt_relative_ess), 6) as mean_median_prompt_relative_ess, round(avg((estimate_status <> 'ok')::int), 6) as nonfinite_case_fraction from fixed join ci using (split, training_seed, behavior_step, target_step, purpose, estimator) group by 1, 2"),
    "lag_table": w(FULL, _lag),
    "training_summary": """with m as (select o_orderkey % 3 + 20260826 as training_seed, cast(o_orderkey as bigint) as step, o_totalprice / 1e5 as mean_reward, cast(o_orderkey % 7 as double) / 7e0 as correctness_reward, o_totalprice as mem, case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 400 as double) end as tps from orders)
select training_seed, max(step) as final_step, round(arg_max(mean_reward, step), 4) as final_mean_reward, round(arg_max(correctness_reward, step), 4) as final_correctness_reward, round(max(mem), 4) as peak_gpu_memory_bytes, round(avg(tps), 4) as mean_tokens_per_second from m group by 1""",
    "latest_metrics": """with r as (select o_custkey % 3 as training_seed, o_orderkey % 50 as step, o_orderkey as record_index, case when o_orderkey % 4 = 0 then null else o_totalprice end as mean_reward, case when o_orderkey % 8 = 0 then null else 1e0 end as kl_proxy, o_orderkey * 10 as num_tokens, cast(o_orderkey % 50 as double) * 2e0 as elapsed_seconds, case when o_orderkey % 3 = 0 then 5e0 end as tokens_per_second from orders),
l as (select * from r qualify row_number() over (partition by training_seed, step order by record_index desc) = 1)
, d as (select * exclude (tokens_per_second), coalesce(tokens_per_second, greatest(num_tokens - lag(num_tokens) over w, 0) / case when elapsed_seconds - lag(elapsed_seconds) over w > 0 then elapsed_seconds - lag(elapsed_seconds) over w end) as tps from l where mean_reward is not null or kl_proxy is not null window w as (partition by training_seed order by step))
select training_seed, step, record_index, round(mean_reward, 4) as mean_reward, round(kl_proxy, 4) as kl_proxy, num_tokens, round(elapsed_seconds, 4) as elapsed_seconds, round(tps, 4) as tokens_per_second from d""",
    "heatmap": w(FIXTURE, stats(), diagnostics(), f"""
t as (select split, ps.relative_ess, pair_abs_mean_log_ratio_per_token as drift, ['Q1_short', 'Q2', 'Q3', 'Q4_long'][cast(least(3, 4 * (row_number() over (partition by {P} order by ps.mean_completion_length, prompt_id) - 1) // count(*) over (partition by {P})) as bigint) + 1] as length_quantile from ps join diag using ({P}) where behavior_step = 0),
e as (select split, quantile_cont(drift, [0.25, 0.5, 0.75]) as q from t group by 1)""", "select split, length_quantile, cast(case when drift < q[1] then 1 when drift < q[2] then 2 when drift < q[3] then 3 else 4 end as bigint) as drift_quantile, round(median(relative_ess), 6) as median_relative_ess, count(*) as n from t join e using (split) group by 1, 2, 3"),
    "spearman": w(FULL, """
long as (select split, scope, estimator, absolute_error, d as diagnostic, case when d in ('median_prompt_relative_ess', 'mean_d2') then 'second_order_overlap' when d = 'mean_max_normalized_weight' then 'weight_concentration' else 'first_order_drift' end as diagnostic_family,
  case d when 'median_prompt_relative_ess' then median_prompt_relative_ess when 'mean_d2' then mean_d2 when 'mean_max_normalized_weight' then mean_max_normalized_weight when 'tokenwise_kl_proxy' then tokenwise_kl_proxy else mean_abs_log_weight end as value
  from (select *, 'pooled' as scope from fixed union all select *, cast(training_seed as varchar) from fixed) cross join (select unnest(['median_prompt_relative_ess', 'mean_d2', 'mean_max_normalized_weight', 'tokenwise_kl_proxy', 'mean_abs_log_weight']) as d) where estimator = 'prompt_wis'),
rk as (select *, rank() over (partition by split, scope, diagnostic order by value) + (count(*) over (partition by split, scope, diagnostic, value) - 1) / 2e0 as x, rank() over (partition by split, scope, diagnostic order by absolute_error) + (count(*) over (partition by split, scope, diagnostic, absolute_error) - 1) / 2e0 as y from long),
c as (select split, scope, estimator, diagnostic, diagnostic_family, count(*) as n_pair_cases, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) as r from rk group by all)""", "select split, scope, estimator, diagnostic, diagnostic_family, n_pair_cases, round(r, 6) as spearman_with_absolute_error, round(abs(r), 6) as absolute_spearman from c"),
    "horizon": w(FULL, TOLERANCES, horizon(False)),
    "horizon_prefix": w(FULL, TOLERANCES, horizon(True)),
    "mc_inclusion": w(MATCHED, estimates(), replicates(True), f"select split, estimator, count(*) as n_pair_seed_cases, count_if(ope_ci_low <= online_reference and online_reference <= ope_ci_high) as mc_reference_inclusion_count, round(count_if(ope_ci_low <= online_reference and online_reference <= ope_ci_high) / count(*), 6) as mc_reference_inclusion_rate from ci join ref using (split, training_seed, target_step) where purpose = 'fixed' and behavior_step = 0 and target_step > 0 group by 1, 2"),
    "pooled_error": w(FULL, "select split, estimator, target_step, round(avg(absolute_error), 6) as mean_absolute_error, count(*) as n from fixed group by 1, 2, 3"),
    "paper_values": w(FULL, """
v as (select split || '.' || estimator || '.' || m as key, case m when 'rmse' then sqrt(avg(signed_error * signed_error)) else avg(absolute_error) end as x from fixed cross join (select unnest(['mean_absolute_error', 'rmse']) as m) group by split, estimator, m)""", "select key, case when x <> 0 and (abs(x) >= 1000 or abs(x) < 1e-3) then format('{:.3e}', round(x, 8)) else format('{:.4f}', round(x, 8)) end as value from v"),
    "prompt_id": w(PROMPTS, "select source_row_index, prompt_id from prompts"),
    "split_registry": w(PROMPTS, "h as (select *, sha256('split-v1|' || prompt_id) as split_assignment_hash from prompts)", "select source_row_index, original_split, case when original_split <> 'train' then original_split when row_number() over (partition by original_split order by split_assignment_hash, prompt_id) <= 100 then 'training' else 'development' end as research_split, split_assignment_hash from h"),
    "duplicate_questions": "select cast(coalesce(sum(n - 1), 0) as bigint) as n_extra from (select p_name, count(*) as n from part group by 1)",
    "answer_parse": w(FORMS, """select o_orderkey, case f when 2 then 'invalid_answer_value' when 3 then 'multiple_answer_tags' when 4 then 'missing_answer_tag' when 5 then 'invalid_answer_value' when 6 then 'invalid_answer_value' when 8 then 'missing_answer_tag' else 'ok' end as status,
  case f when 2 then 'invalid_numeric_answer' when 3 then 'multiple_answer_tags' when 4 then 'missing_answer_tag' when 5 then 'invalid_numeric_answer' when 6 then 'invalid_numeric_answer' when 8 then 'missing_answer_tag' else 'ok' end as strict_status,
  cast(case f when 0 then o_custkey when 1 then 1000 + o_custkey % 1000 when 7 then -(o_custkey * 100 + 50) end as double) as num, cast(case f when 0 then 1 when 1 then 2 when 7 then 100 end as double) as den from forms"""),
    "answer_canonical": w(FORMS, """q as (select o_orderkey, f, case f when 0 then o_custkey when 1 then 1000 + o_custkey % 1000 else -(o_custkey * 100 + 50) end as num, case f when 0 then 1 when 1 then 2 else 100 end as den from forms)""", "select o_orderkey, case when f not in (0, 1, 7) then null when den // gcd(num, den) = 1 then cast(num // gcd(num, den) as varchar) else (num // gcd(num, den)) || '/' || (den // gcd(num, den)) end as answer from q"),
    "rewards": w(FORMS, "select o_orderkey, case when f = 0 then 1e0 when f = 1 and 1000 + o_custkey % 1000 = 2 * o_custkey then 1e0 else 0e0 end as correctness, case when f in (0, 1, 7) then 1e0 else 0e0 end as format from forms"),
    "seq_logprob": w(TOKENS, "select l_orderkey, len(e) as n_tokens, round(list_sum(list_transform(e, lambda x: -x / 1e5)), 8) as sequence_logprob from tok"),
    "first_eos": w(TOKENS, "i as (select l_orderkey, list_transform(s, lambda x: x % 7) as ids from tok)", "select l_orderkey, cast(coalesce(least(case when list_position(ids, 0) > 0 then list_position(ids, 0) end, case when list_position(ids, 3) > 0 then list_position(ids, 3) end), case when len(ids) >= 5 then 5 end) as double) as cut from i"),
    "logp_compare": w(TOKENS, "d as (select l_orderkey, list_transform(s, lambda x: case when x % 5 = 0 then 25e-2 else 0e0 end) as d from tok)", "select l_orderkey, round(list_max(d), 6) as max_diff, round(list_sum(d) / len(d), 6) as mean_diff, case when list_position(d, 25e-2) > 0 then cast(list_position(d, 25e-2) - 1 as double) end as first_mismatch from d"),
    "shards": w(FIXTURE, "p as (select distinct split, prompt_id from fx_trajectories), r as (select *, (row_number() over (partition by split order by prompt_id) - 1) // 25 as shard from p)", "select split, shard, count(*) as n_prompts, min(prompt_id) as first_prompt, start, stop from r cross join (select cast(0 as bigint) as start, cast(8 as bigint) as stop union all select 8, 16 union all select 16, 20) group by split, shard, start, stop"),
    "completeness": w(FIXTURE, "select * from (select prompt_id, count(*) as n, min(sample_index) as least, max(sample_index) as most, count(distinct sample_index) as \"distinct\" from fx_trajectories group by 1) where not (n = 50 and least = 0 and most = 49 and \"distinct\" = 50)"),
    "missing_units": w(FIXTURE, "select training_seed, behavior_step, target_step from fx_pairs where target_step % 40 <> 0"),
    "scope_replace": w(FIXTURE, "o as (select split, prompt_id, count(*) as n from fx_trajectories group by 1, 2)", "select * from o where split <> 'test' union all select split, prompt_id, -n from o where split = 'test' and n > 50"),
    "content_hash_rows": w(FIXTURE, """
hashed as (select purpose, sha256('{"behavior_step":' || behavior_step || ',"purpose":"' || purpose || '","s":' || s || ',"target_step":' || target_step || ',"training_seed":' || training_seed || '}') as h from fx_pairs),
parts as (select purpose, count(*) as n_rows, sum(cast('0x' || substr(h, 1, 15) as bigint)) as a, sum(cast('0x' || substr(h, 16, 15) as bigint)) as b, sum(cast('0x' || substr(h, 31, 15) as bigint)) as c, sum(cast('0x' || substr(h, 46, 15) as bigint)) as d from hashed group by 1)""", "select purpose, n_rows, sha256(concat_ws('|', a, b, c, d, n_rows)) as content_sha256 from parts"),
    "grid_candidates": w(FULL, GRID, """select p.candidate_id, p.scope, p.tolerance, n_fixed, n_rolling, round(p.mae, 6) as fixed_mean_mae, round(p.red, 6) as rolling_mean_error_reduction, round(p.rate, 6) as gate_accept_rate, round(abs(p.mae - w.mae), 6) as absdiff_fixed_mean_mae, round(abs(p.rate - w.rate), 6) as absdiff_gate_accept_rate from part p join whole w using (scope, tolerance)"""),
    "ref_sample_size": w(FULL, """
l as (select unnest([2, 4, 8]) as "L"), pp as (select split, training_seed, target_step, prompt_id, "L", avg(correct) as f, avg(case when sample_index < "L" then correct end) as c from fx_online cross join l group by 1, 2, 3, 4, 5),
tt as (select split, training_seed, target_step, "L", avg(f) as fr, avg(c) as cr, avg(abs(c - f)) as pm, quantile_cont(abs(c - f), 0.95) as pp from pp group by 1, 2, 3, 4),
ee as (select tt.*, abs(abs(estimate - cr) - abs(estimate - fr)) as ch, abs(cr - fr) as gap from fixed join tt using (split, training_seed, target_step) where estimator = 'prompt_wis')""", """select split, cast("L" as bigint) as "L", count(*) as n, round(avg(gap), 6) as mean_reference_diff, round(median(gap), 6) as median_reference_diff, round(quantile_cont(gap, 0.95), 6) as p95_reference_diff, round(max(gap), 6) as max_reference_diff, round(avg(pm), 6) as mean_prompt_mae, round(max(pp), 6) as max_prompt_p95,
  round(avg(ch), 6) as mean_error_change, round(median(ch), 6) as median_error_change, round(quantile_cont(ch, 0.95), 6) as p95_error_change, round(max(ch), 6) as max_error_change from ee group by 1, 2"""),
    "common_prefix": w(FIXTURE, """
per as (select split, training_seed, target_step, prompt_id, count(distinct sample_index) as n, count(*) as rows from fx_online group by 1, 2, 3, 4),
l as (select split, training_seed, target_step, min(n) as full_l, count(*) as n_prompts from per group by 1, 2, 3),
held as (select split, training_seed, target_step, prompt_id, count(distinct sample_index) as k from fx_online join l using (split, training_seed, target_step) where sample_index < full_l group by 1, 2, 3, 4),
conf as (select split, training_seed, target_step, sum(k - 1) as n_conflicts from (select split, training_seed, target_step, prompt_id, sample_index, count(distinct correct) as k from fx_online group by 1, 2, 3, 4, 5) group by 1, 2, 3)""",
      "select split, training_seed, target_step, full_l, n_prompts, min(k) = full_l as valid, cast(max(n_conflicts) as bigint) as n_conflicts from l join held using (split, training_seed, target_step) join conf using (split, training_seed, target_step) group by 1, 2, 3, 4, 5"),
    "subset_benchmark": w(SUBSET, "select split, fraction, tolerance, round(avg(agreement), 6) as mean_gate_agreement, round(avg(ad), 6) as mean_accept_rate_diff, round(avg(mc), 6) as mean_median_error_change, round(quantile_cont(pc, 0.95), 6) as p95_of_p95_error_change from each group by 1, 2, 3"),
    "subset_recommendation": w(SUBSET, "s as (select split, fraction, tolerance, avg(agreement) as a, avg(ad) as d, avg(mc) as m, quantile_cont(pc, 0.95) as p from each group by 1, 2, 3)", "select min(case when ok then fraction end) as recommended_fraction from (select fraction, bool_and(a >= 5e-1 and d <= 5e-1 and m <= 5e-1 and p <= 5e-1) as ok from s group by 1)"),
    "identity_check": w(FIXTURE, "select 'identity_weight' as rule, count(*) as n from fx_rescores where purpose = 'identity' and trajectory_id % 101 = 0 having count(*) > 0"),
    "statistics_check": w(FIXTURE, stats(), 'select count(*) as n_breaks from ps where ess < 1 - 1e-9 or ess > "K" + 1e-8 or pwis < 0 or pwis > 1 + 1e-12 or alpha < 0 or alpha > 1 + 1e-12'),
    "prompt_set_check": w(FIXTURE, "a as (select distinct prompt_id from fx_trajectories where sample_index < 16), b as (select distinct prompt_id from fx_trajectories where sample_index >= 45)", "select prompt_id, 'right' as missing from a where prompt_id not in (select prompt_id from b) union all select prompt_id, 'left' from b where prompt_id not in (select prompt_id from a)"),
    "conflict_check": "select user_id, count(distinct event_type) + max((event_type is null)::int) as n from events group by 1 having count(distinct event_type) + max((event_type is null)::int) > 1",
    "grid_gap_check": w(FIXTURE, "select training_seed, step as target_step from fx_seeds cross join fx_steps where step = 0"),
    "reference_check": w(FIXTURE, ONLINE, "select count(*) as n_breaks from acc where n_samples <> 8"),
    "pair_registry": w("""b as (select unnest([0, 100, 200, 300]) as b), e as (select unnest(range(0, 401, 20)) as e), s as (select unnest([20260826, 20260827, 20260828]) as s), x as (select unnest(['development', 'test']) as x),
r as (select s as training_seed, x as split, b as behavior_step, e as target_step, case when b = e then 'identity' when b = 0 then 'fixed' else 'rolling' end as purpose from b, e, s, x where b = e or (b = 0 and e > 0) or (b > 0 and e > b and e <= b + 100))""", """select cast(training_seed as bigint) as training_seed, split, cast(behavior_step as bigint) as behavior_step, cast(target_step as bigint) as target_step, purpose, 'v1' as protocol_version,
  sha256('{"behavior_step":' || behavior_step || ',"protocol_version":"v1","purpose":"' || purpose || '","split":"' || split || '","target_step":' || target_step || ',"training_seed":' || training_seed || '}') as pair_id from r"""),
    "next_pair": w(FIXTURE, """n as (select split, (count(distinct prompt_id) + 9) // 10 as shards from fx_trajectories group by 1),
p as (select distinct training_seed, split, behavior_step, target_step, purpose, shards * 2 as n_source, (shards - (shards + 4) // 5) * 2 as n_output from fx_pairs cross join n where behavior_step >= 200)""", """select training_seed, split, behavior_step, target_step, purpose, 'v1' as protocol_version,
  sha256('{"behavior_step":' || behavior_step || ',"protocol_version":"v1","purpose":"' || purpose || '","split":"' || split || '","target_step":' || target_step || ',"training_seed":' || training_seed || '}') as pair_id, n_source, n_output
  from p order by case purpose when 'identity' then 0 when 'fixed' then 1 else 2 end, training_seed, split, behavior_step, target_step limit 1"""),
    "representable": """with r as (select cast(n_nationkey as bigint) as i, case when n_nationkey = 0 then null else (n_nationkey - 12) * 75e0 end as z from nation)
select i, case when z is null then 'ok' when z > 709.782712893384 then 'nonfinite_estimator' when z < -744.4400719213812 then 'ok_underflow_to_zero' else 'ok' end as status, case when z is null or z < -700 then 0e0 when z < 6 then round(exp(z), 6) end as value from r""",
}

ORACLES |= {
    "canonical_denominator": w(FIXTURE, "select training_seed, trajectory_id, behavior_step, target_step, round(log_weight, 9) + 0e0 as log_weight, round(log_weight / completion_length, 9) + 0e0 as mean_log_ratio_per_token from fx_rescores where purpose <> 'identity'"),
    "rescore_summary": w(FIXTURE, f"select {P}, count(*) as n_rows, round(max(abs(log_weight)), 6) as max_abs_log_weight, round(avg(abs(log_weight)), 6) as mean_abs_log_weight, round(max(abs(log_weight / completion_length)), 6) as max_bridge_diff, round(avg(abs(log_weight / completion_length)), 6) as mean_bridge_diff, count_if(abs(log_weight / completion_length) > 1e-2) as n_bridge_over from fx_rescores group by {P}"),
    "source_join": w(FIXTURE, "select r.training_seed, r.behavior_step, r.target_step, r.trajectory_id, round(r.log_weight, 6) + 0e0 as log_weight, t.prompt_id, t.sample_index from fx_rescores r join fx_trajectories t on t.event_id = r.trajectory_id"),
    "source_coverage": w(FIXTURE, "select event_id as trajectory_id, 'left' as missing from fx_trajectories where sample_index < 16 and event_id % 50 = 0"),
    "parser_counts": w(FORMS, "a as (select o_custkey % 3 as k, f in (0, 1, 7) as ok, f in (4, 8) as missing, cast(o_orderkey % 2 as double) as r, o_orderkey % 5 = 0 as t from forms)", "select k, count_if(ok) as n_ok, count_if(missing) as n_missing, count(*) as n_rows, count_if(t) as n_truncated, round(avg(r), 6) as mean_reward from a group by 1"),
    "sample_limit": w(FIXTURE, "select step, cast(case when step in (100, 200, 300, 400) then 32 else 8 end as bigint) as n_samples from fx_steps"),
    "generation_call": w(FIXTURE, """
u as materialized (select *, 'c' || (event_id % 40) as generation_call_id from fx_trajectories where sample_index < 16),
o as (select split, generation_call_id, row_number() over (partition by split order by min(prompt_id * 1000 + sample_index), generation_call_id) - 1 as pos from u group by 1, 2)""", "select split, generation_call_id, prompt_id, sample_index from u join o using (split, generation_call_id) where pos = 2"),
    "mixed_fields": "select cast(c_nationkey as bigint) as c_nationkey, 'c_mktsegment' as field, cast(count(distinct c_mktsegment) + max((c_mktsegment is null)::int) as bigint) as n_values from customer group by 1 having count(distinct c_mktsegment) + max((c_mktsegment is null)::int) > 1",
    "formal_failures": w(FIXTURE, "i as (select * from fx_rescores where purpose = 'identity')", "select training_seed, target_step, trajectory_id, 'failed' as kind from i where trajectory_id % 11 = 0 union all select training_seed, target_step, trajectory_id, 'wrong_flag' from i where (trajectory_id % 22 > 0) = (trajectory_id % 11 = 0)"),
    "identity_gate": w(FIXTURE, "select training_seed, cast(200 as bigint) as anchor from fx_seeds"),
    "shard_index": "select cast(n_regionkey as bigint) as k, count(*) as n_shards, cast(sum(n_nationkey) as bigint) as n_rows, sha256(string_agg(sha256(n_name), chr(10) order by n_name)) as shard_set_sha256 from nation group by 1",
    "coerced": "select cast(n_nationkey as bigint) as i, case n_nationkey % 5 when 0 then 'true' when 1 then 'false' end as flag, n_nationkey % 5 in (3, 4) as bad_flag, case n_nationkey % 5 when 1 then 0e0 when 3 then 15e-1 end as number, n_nationkey % 5 in (0, 4) as bad_number from nation",
    "first_metric": "select cast(n_nationkey as bigint) as i, case when n_nationkey % 3 > 0 then case when n_nationkey % 2 = 0 then cast(n_nationkey as double) end else n_nationkey * 10e0 end as value from nation",
    "json_values": "select event_id, json_extract_string(props, '$.k') as k, 'k' || chr(10) || event_type as text from events",
}


def bigint_counts(sql: str) -> str:
    """count_if gives a wider integer than a count; a filtered count gives bigint."""
    out, at = [], 0
    while (lo := sql.find("count_if(", at)) >= 0:
        depth, hi = 1, lo + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[hi], 0)
            hi += 1
        out += [sql[at:lo], "count(*) filter (where ", sql[lo + len("count_if(") : hi - 1], ")"]
        at = hi
    return "".join([*out, sql[at:]])


ORACLES = {k: bigint_counts(v) for k, v in ORACLES.items()}
