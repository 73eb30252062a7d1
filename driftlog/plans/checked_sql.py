"""SQL of the queries in ``checked``."""

from __future__ import annotations

from driftlog.operators.rescoring import spaced_targets
from driftlog.plans.oracles import FIXTURE, FULL, GATE, ONLINE, PROMPTS, P, bigint_counts, rounds, stats, w

STATS = ",".join([FIXTURE, stats()])
MATCHED = ",".join([FIXTURE, stats(), ONLINE])
DESIGN = """design as (select s.training_seed, x.split, b.b as behavior_step, e.e as target_step, case when b = e then 'identity' when b = 0 then 'fixed' else 'rolling' end as purpose
  from (select unnest([20260826, 20260827, 20260828]) as training_seed) s cross join (select unnest(['development', 'test']) as split) x cross join (select unnest([0, 100, 200, 300]) as b) b cross join (select unnest(range(0, 401, 20)) as e) e
  where b = e or (b = 0 and e > 0) or (b > 0 and e > b and e <= b + 100))"""

EXTREME = """
v as (select unnest(range(8)) as i, unnest([900e0, -900e0, 8000e0, -8000e0, cast('nan' as double), cast('inf' as double), cast('-inf' as double), 0e0]) as z),
f as (select i, z, isnan(z) or z = cast('inf' as double) as bad, z = cast('-inf' as double) as none from v),
o as (select i, bad, none, case when bad or none then null else z - ln(2) end as lg, case when bad then null when none then 0e0 when z >= 0 then 1 / (1 + exp(-z)) else exp(z) / (1 + exp(z)) end as pw from f),
e as (select i, 'is' as estimator, case when bad or lg > 709.78 then null when none or lg < -744.4 then 0e0 else exp(least(lg, 700e0)) end as estimate, case when bad or lg > 709.78 then 'nonfinite_estimator' when none then 'ok' when lg < -744.4 then 'ok_underflow_to_zero' else 'ok' end as estimate_status from o
  union all select i, 'prompt_wis', pw, case when bad then 'nonfinite_estimator' else 'ok' end from o)"""

SPOILT = f"""
lq as (select {P}, prompt_id from ps),
s as (select 'training' as "table", 'step' as rule, count(*) as n from orders where o_orderkey % 10 = 0 and o_orderkey > 0
  union all select 'training', 'truncation_rate', count(*) from orders where o_orderkey % 9 = 0
  union all select 'training', 'mode', count(*) from orders where o_orderkey % 8 = 0
  union all select 'fixed', 'behavior_step', count(*) from fixed where target_step = 20
  union all select 'fixed', 'K', count(*) from fixed where target_step = 40
  union all select 'fixed', 'signed_error', count(*) from fixed where target_step = 60
  union all select 'fixed', 'absolute_error', count(*) from fixed where target_step = 100
  union all select 'fixed', 'median_relative_ess', count(*) from fixed where target_step = 120
  union all select 'overlap', r, count(*) from ps cross join (select unnest(['ess', 'ess_ratio']) as r) where prompt_id % 5 = 0 group by r
  union all select 'overlap', 'max_normalized_weight', count(*) from ps where prompt_id % 7 = 0
  union all select 'overlap', 'length_quantile', count(*) from ps where prompt_id % 11 = 0
  union all select 'rolling', 'delta_error', count(*) from rolling where target_step % 120 = 0
  union all select 'rolling', 'recent_before_target', count(*) from rolling where target_step % 80 = 0
  union all select 'decisions', 'reliable', count(*) from judged where target_step = 100
  union all select 'decisions', 'false_accept', count(*) from judged where target_step = 100 and accepted
  union all select 'decisions', 'false_reject', count(*) from judged where target_step = 100 and not accepted
  union all select 'decisions', 'decision', count(*) from judged where target_step = 200 and accepted)"""

ONLINE_FAULTS = """
o as (select *, prompt_id * 100 + target_step + sample_index as id from fx_online),
p as (select *, id % 83 = 0 or id % 40 = 39 as cut, case when id % 89 = 0 then 0 else id % 40 + 1 end as len from o),
r as (select unnest(list_filter([case when id % 97 = 0 then 'online_id' end, case when sample_index > 6 then 'sample_index' end, case when id % 79 = 0 then 'binary_reward' end, case when len <= 0 then 'length' end,
  case when id % 3 = 0 and cut then 'ended_and_truncated' end, case when cut and len <> 40 then 'truncated_length' end], lambda x: x is not null)) as rule from p
  union all select 'incomplete' from p group by training_seed, split, target_step, prompt_id having count(*) <> 8 or min(sample_index) <> 0 or max(sample_index) <> 7 or count(distinct sample_index) <> 8)"""

REGISTRY = f"""{PROMPTS},
reg as (select source_row_index as i, original_split, sha256('split-v1|' || prompt_id) as h from prompts),
r as (select unnest(list_filter([case when i % 60 = 0 then 'assignment_hash' end, case when i % 50 = 0 and original_split = 'test' then 'test_leak' end, case when i % 50 = 1 and original_split = 'train' then 'train_split' end,
  case when (i % 50 = 0 and original_split = 'test') or (i % 50 = 1 and original_split = 'train') then 'membership' end], lambda x: x is not null)) as rule from reg)"""

PROMPT_SETS = f"""
a as (select * from acc where not (target_step = 40 and prompt_id % 9 = 0)),
k as (select split, training_seed, target_step, count(distinct prompt_id) as n_reference from a group by 1, 2, 3),
c as (select {", ".join("s." + x.strip() for x in P.split(","))}, count(*) filter (where a.prompt_id is null) as without_reference, count(a.prompt_id) as hit from ps s
  left join a on a.split = s.split and a.training_seed = s.training_seed and a.target_step = s.target_step and a.prompt_id = s.prompt_id where not (s.target_step = 60 and s.prompt_id % 10 = 0) group by all)"""

SIDES = """
k as (select split, training_seed, behavior_step, target_step, purpose, prompt_id, count(*) as k from fx_rescores where not (purpose = 'rolling' and target_step = 120 and prompt_id % 9 = 0) and not (purpose = 'rolling' and target_step = 140 and sample_index = 3) group by all),
o as (select * from k where behavior_step = 0 and purpose = 'fixed'),
b as (select n.split, n.training_seed, n.target_step, n.behavior_step as recent_behavior_step, count(*) as n_recent, count(o.k) as n_both, count_if(n.k <> o.k) as n_other_k from k n
  left join o on o.split = n.split and o.training_seed = n.training_seed and o.target_step = n.target_step and o.prompt_id = n.prompt_id where n.purpose = 'rolling' group by 1, 2, 3, 4),
t as (select split, training_seed, target_step, count(*) as n_old from o group by 1, 2, 3)"""


def _grids() -> str:
    out = []
    for name, lags in (("mid", [60]), ("endpoints", [20, 100]), ("balanced2", [40, 80]), ("end_mid", [20, 60, 100])):
        for n in range(1, 13):
            total = 3 * (4 + n + 3 * len(lags))
            if 30 <= total <= 60:
                out.append(f"('C{len(out) + 1:03d}', {total}, {list(spaced_targets(n))}, {lags})")
    return ", ".join(out)


KINDS = {"fixed_mean_mae": "avg(absolute_error) filter (where purpose = 'fixed')", "fixed_mean_ress": "avg(ress) filter (where purpose = 'fixed')", "rolling_mean_error_reduction": "avg(old_absolute_error - absolute_error) filter (where purpose = 'rolling')", "rolling_fraction_recent_better": "avg((absolute_error < old_absolute_error)::int) filter (where purpose = 'rolling')", "gate_accept_rate": "avg(accept::int)", "gate_false_accept_fraction_all": "avg((accept and absolute_error > tolerance)::int)", "gate_accepted_mae": "avg(absolute_error) filter (where accept)"}
GRIDS = f"""
g as (select training_seed, behavior_step, target_step, 'fixed' as purpose, absolute_error, cast(null as double) as old_absolute_error, median_prompt_relative_ess as ress from fixed where estimator = 'prompt_wis' and split = 'development'
  union all select training_seed, recent_behavior_step, target_step, 'rolling', recent_absolute_error, old_absolute_error, recent_median_relative_ess from rolling where estimator = 'prompt_wis' and split = 'development'),
sc as (select unnest([20260826, 20260827, 20260828]) as training_seed, 'all' as scope union all select 20260828, 'validation'),
thr as (select cast(0.02 as double) as tolerance, cast(0.4 as double) as t union all select cast(0.05 as double), cast(0.2 as double)),
cand(candidate_id, total_pairs, targets, lags) as (values {_grids()}),
x as (select g.*, scope, tolerance, ress >= t as accept from g join sc using (training_seed) cross join thr),
whole as (select scope, tolerance, {", ".join(f"{v} as {k}" for k, v in KINDS.items())} from x group by 1, 2),
part as (select candidate_id, scope, tolerance, {", ".join(f"{v} as {k}" for k, v in KINDS.items())} from x join cand on (purpose = 'fixed' and list_contains(targets, target_step)) or (purpose = 'rolling' and list_contains(lags, target_step - behavior_step)) group by 1, 2, 3),
worst as (select candidate_id, {", ".join(f"max(case when p.{k} is null and o.{k} is null then 0e0 else coalesce(abs(p.{k} - o.{k}), cast('inf' as double)) end) as {k}" for k in KINDS)} from part p join whole o using (scope, tolerance) group by 1),
v as (select c.candidate_id, cast(total_pairs as bigint) as total_pairs, worst.* exclude (candidate_id), {" + ".join(f"{k} / 25e-2" for k in KINDS)} as score, {" and ".join(f"{k} <= 25e-2" for k in KINDS)} as passed from cand c join worst using (candidate_id)),
best as (select candidate_id from v where passed order by total_pairs, score, candidate_id limit 1)"""

PLANS = """
plans(main_l, audit_l) as (values (2, 4), (4, 8), (8, 8), (8, 16)),
per as (select split, training_seed, target_step, prompt_id, count(*) as n from fx_online group by 1, 2, 3, 4),
fl as (select split, training_seed, target_step, min(n) as full_l from per group by 1, 2, 3),
pr as (select o.split, o.training_seed, o.target_step, o.prompt_id, main_l, audit_l, case when o.target_step in (0, 100, 200, 300, 400) then audit_l else main_l end as size, full_l,
  avg(correct) filter (where sample_index < full_l) as f, avg(correct) filter (where sample_index < least(full_l, case when o.target_step in (0, 100, 200, 300, 400) then audit_l else main_l end)) as p from fx_online o join fl using (split, training_seed, target_step) cross join plans group by all),
tg as (select main_l, audit_l, split, training_seed, target_step, avg(f) as f, avg(p) as p, avg(abs(p - f)) as mae, max((size > full_l)::int) as short from pr group by 1, 2, 3, 4, 5),
ev as (select main_l, audit_l, split, training_seed, 'reference' as kind, abs(p - f) as change, mae, short from tg
  union all select main_l, audit_l, split, training_seed, 'fixed', abs(abs(estimate - p) - abs(estimate - f)), null, short from fixed join tg using (split, training_seed, target_step) where estimator = 'prompt_wis'
  union all select main_l, audit_l, split, training_seed, 'rolling', abs(abs(old_estimate - p) - abs(recent_estimate - p) - abs(old_estimate - f) + abs(recent_estimate - f)), null, short from rolling join tg using (split, training_seed, target_step) where estimator = 'prompt_wis'),
sc as (select unnest([20260826, 20260827, 20260828]) as training_seed, 'all' as scope union all select unnest([20260826, 20260827]), 'calibration' union all select 20260828, 'validation')"""

RANKS = """
rk as (select split, training_seed, estimator, rank() over (partition by split, training_seed, estimator order by target_step) + (count(*) over (partition by split, training_seed, estimator, target_step) - 1) / 2e0 as x,
  rank() over (partition by split, training_seed, estimator order by median_prompt_relative_ess) + (count(*) over (partition by split, training_seed, estimator, median_prompt_relative_ess) - 1) / 2e0 as y from fixed)"""

WORDS = "['Zero', 'One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine']"

ORACLES: dict[str, str] = {
    "extreme_weights": "with " + EXTREME + """ select i as target_step, estimator, case when estimate < 1e6 then round(estimate, 9) else round(ln(estimate), 6) end as estimate, estimate_status from e
union all select i, estimator || '_summary', case when estimate < 1e6 then round(estimate, 9) else round(ln(estimate), 6) end, estimate_status from e union all select i, 'global_wis', round(pw, 9), '-' from o""",
    "table_invariants": w(GATE, SPOILT, 'select "table", rule, n from s where n > 0'),
    "online_check": w(FIXTURE, ONLINE_FAULTS, "select rule, count(*) as n from r group by 1"),
    "registry_check": f"with {REGISTRY} select rule, count(*) as n from r group by 1 union all select 'count_' || original_split, count(*) from reg group by original_split having not (original_split = 'train' and count(*) = 1) union all select 'count_validation', 0",
    "lock_check": "select n_name as name, case n_nationkey when 3 then 'not_locked' when 5 then 'changed' else 'not_there' end as kind from nation where n_nationkey in (3, 5, 7)",
    "pair_prompt_check": w(MATCHED, PROMPT_SETS, f"select {P}, without_reference, coalesce(n_reference, 0) - hit as only_reference from c left join k using (split, training_seed, target_step) where without_reference > 0 or coalesce(n_reference, 0) - hit > 0"),
    "side_check": w(FIXTURE, SIDES, "select split, training_seed, target_step, recent_behavior_step, n_recent, n_both, n_other_k, coalesce(n_old, 0) as n_old from b left join t using (split, training_seed, target_step) where n_recent <> n_both or coalesce(n_old, 0) <> n_both or n_other_k > 0"),
    "rederivation_check": w(FULL, "select case target_step when 40 then 'n_prompts' when 60 then 'median_relative_ess' else 'statistics' end as rule, count(*) as n from res where estimator = 'is' and target_step in (40, 60, 80) group by 1"),
    "identity_difference_check": w(FIXTURE, """r as (select unnest(list_filter(case when purpose = 'identity' then [case when trajectory_id % 11 = 0 or trajectory_id % 13 = 0 then 'token_difference' end, case when trajectory_id % 17 = 0 then 'identity_pass' end]
  else [case when trajectory_id % 501 = 0 then 'only_identity' end] end, lambda x: x is not null)) as rule from fx_rescores)""", "select rule, count(*) as n from r group by 1"),
    "kept_pairs": w(DESIGN, """select split, cast(training_seed as bigint) as training_seed, cast(behavior_step as bigint) as behavior_step, target_step, purpose from design where split = 'test' and training_seed in (20260826, 20260828)
  and (purpose = 'identity' or (purpose = 'fixed' and target_step in (20, 120, 220, 300, 400, 160, 260, 360)) or (purpose = 'rolling' and target_step = behavior_step + 60))"""),
    "selected_pairs": w(DESIGN, "select '-' as pair_id, cast(training_seed as bigint) as training_seed, cast(behavior_step as bigint) as behavior_step, target_step, split from design where training_seed < 20260828 and target_step % 80 = 0 union all select r_name, -1, -1, -1, '-' from region"),
    "row_lookup": "select c_custkey as source_row_index, c_custkey % 40 > 0 and c_custkey % 30 > 0 as found from customer",
    "split_counters": f"with {PROMPTS}, h as (select *, row_number() over (partition by original_split order by sha256('split-v1|' || prompt_id), prompt_id) as k from prompts), s as (select original_split, case when original_split <> 'train' then original_split when k <= 100 then 'training' else 'development' end as research_split from h) select 'original_split' as \"column\", original_split as value, count(*) as n from s group by 2 union all select 'research_split', research_split, count(*) from s group by 2",
    "latest_by_path": "select o_custkey as path, max(o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as state from orders group by 1",
    "batches": "select cast(c_nationkey as bigint) as c_nationkey, batch, count(*) as n, cast(min(c_custkey) as bigint) as first from (select *, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 4 as batch from customer) group by 1, 2",
    "first_prompts": f"with {PROMPTS} select source_row_index, prompt_id from prompts order by prompt_id limit 25",
    "step_overlap": w(FULL, RANKS, "select split, training_seed, estimator, count(*) as n_pair_cases, round(corr(x, y), 6) as spearman from rk group by 1, 2, 3"),
    "matched_refresh": w(FULL, f"select split, training_seed, count(*) as n, {rounds('mean_old_absolute_error mean_recent_absolute_error mean_old_median_relative_ess mean_recent_median_relative_ess')}, n_recent_better from (select split, training_seed, count(*) as c, avg(old_absolute_error) as mean_old_absolute_error, avg(recent_absolute_error) as mean_recent_absolute_error, avg(old_median_relative_ess) as mean_old_median_relative_ess, avg(recent_median_relative_ess) as mean_recent_median_relative_ess, count_if(recent_absolute_error < old_absolute_error) as n_recent_better from rolling where estimator = 'prompt_wis' group by 1, 2)".replace("count(*) as n, ", "c as n, ", 1)),
    "escaped": f"""select cast(n_nationkey as bigint) as i, replace(n_name, '_', '\\_') || ' 10\\% of \\$5 \\& \\#1\\_\\{{x\\}}\\textasciitilde{{}}\\textasciicircum{{}}\\textbackslash{{}} ' || n_nationkey as text,
  'Value' || array_to_string(list_transform(regexp_extract_all(lower(n_name) || '-tau.0' || n_nationkey, '[A-Za-z]+|[0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then array_to_string(list_transform(string_split(p, ''), lambda c: {WORDS}[cast(c as int) + 1]), '') else upper(p[1]) || p[2:] end), '') as macro from nation""",
    "gate_validation": w(GATE, "select case evaluation_role when 'official_test' then 'Official test' else 'Held-out seed' end as evaluation_role, tolerance, count(*) as n_pair_seed_cases, round(count_if(accepted) / count(*), 6) as accept_rate, count_if(false_accept) as false_accept_count, round(avg(absolute_error), 6) as overall_mae from judged where gate_kind = 'primary_ress' group by 1, 2"),
    "error_series": w(FULL, "select split, training_seed, estimator, string_agg(target_step || ':' || cast(round(absolute_error * 1e4) as bigint), ' ' order by target_step, absolute_error) as points from fixed group by 1, 2, 3"),
    "scope_hash": w(FIXTURE, """
h as (select split, sha256('{"event_id":' || event_id || ',"prompt_id":' || prompt_id || ',"sample_index":' || sample_index || ',"split":"' || split || '"}') as h from fx_trajectories),
parts as (select split, count(*) as n_rows, sum(cast('0x' || substr(h, 1, 15) as bigint)) as a, sum(cast('0x' || substr(h, 16, 15) as bigint)) as b, sum(cast('0x' || substr(h, 31, 15) as bigint)) as c, sum(cast('0x' || substr(h, 46, 15) as bigint)) as d from h group by 1)""", "select split, n_rows, split <> 'test' as unchanged, sha256(concat_ws('|', a, b, c, d, n_rows)) as before from parts"),
    "column_subset": "select n_name, true as absent, cast(n_nationkey as bigint) as n_nationkey from nation",
    "grid_verdicts": w(FULL, GRIDS, "select candidate_id, total_pairs, round(fixed_mean_mae, 6) as worst_fixed_mean_mae, round(rolling_mean_error_reduction, 6) as worst_rolling_mean_error_reduction, round(gate_accept_rate, 6) as worst_gate_accept_rate, round(score, 6) as distortion_score, passed, candidate_id in (select candidate_id from best) as recommended from v"),
    "sample_plans": w(FULL, PLANS, "select cast(main_l as bigint) as main_l, cast(audit_l as bigint) as audit_l, split, scope, kind, count(*) as n, round(avg(change), 6) as mean_change, round(median(change), 6) as median_change, round(quantile_cont(change, 0.95), 6) as p95_change, round(max(change), 6) as max_change, round(avg(mae), 6) as mean_prompt_mae, max(short) = 0 as valid from ev join sc using (training_seed) group by 1, 2, 3, 4, 5"),
}

ORACLES = {k: bigint_counts(v) for k, v in ORACLES.items()}
