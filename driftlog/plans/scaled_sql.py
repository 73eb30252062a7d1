"""SQL of the queries in ``scaled``."""

from __future__ import annotations

from driftlog.operators.rescoring import spaced_targets
from driftlog.operators.studies import IDENTITY_STEPS, LAG_PATTERNS, ROLLING_ANCHORS
from driftlog.plans.oracles import CI, FIXTURE, FULL, MATCHED, REPS, P, estimates, rounds, stats, w

STATS = ",".join([FIXTURE, stats()])
SHARES = {"p025": 0.025, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p975": 0.975}
SELECTED = ("ess", "d2", "max_normalized_weight", "log_is", "mean_completion_length")


def mixed(source: str, name: str) -> str:
    """Columns that end in ``name``, a hash of 32 bits of ``source``; each uses the one before."""
    times = lambda x, k: f"cast({x}::hugeint * {k} % 4294967296 as bigint)"
    return f"""{source} as {name}_0, xor({name}_0, {name}_0 >> 16) as {name}_1, {times(f"{name}_1", 0x85EBCA6B)} as {name}_2, xor({name}_2, {name}_2 >> 13) as {name}_3,
  {times(f"{name}_3", 0xC2B2AE35)} as {name}_4, xor({name}_4, {name}_4 >> 16) as {name}"""


def blocks(paired: bool) -> str:
    """Replicates of pairs of one leaf, which all pairs of the small tables are: draws are hashes of seed, replicate and draw."""
    stream = "''" if paired else "estimator"
    odd = lambda k: f"xor(base, cast((2 * rep + {k})::hugeint * {0x9E3779B1} % 4294967296 as bigint))"
    return f"""
heads as (select distinct name, n from ranked),
seeded as (select name, n, estimator, rep, cast('0x' || substr(md5(name || '|' || {stream}), 1, 8) as bigint) as seed from heads cross join (select unnest(range({REPS})) as rep) cross join (select unnest(['is', 'prompt_wis']) as estimator)),
based as (select name, n, estimator, rep, {mixed("seed", "base")} from seeded),
keyed as (select name, n, estimator, rep, {mixed(odd(0), "a")}, {mixed(odd(1), "b")} from based),
counted as (select name, n, estimator, rep, a, b, unnest(range(n)) as i from keyed),
once as (select name, n, estimator, rep, b, {mixed("xor(a, i)", "u")} from counted),
draws as (select name, n, estimator, rep, {mixed("(u + b) % 4294967296", "v")}, cast((v::hugeint * n) >> 32 as bigint) as pick from once),
tops as (select name, max(log_is) as top from ranked group by name),
reps as (select {", ".join("x." + c.strip() for c in P.split(","))}, estimator, rep, case when estimator = 'is' then coalesce(exp(max(top) + ln(nullif(sum(coalesce(exp(log_is - top), 0e0)), 0)) - ln(max(x.n))), 0e0) else avg(pwis) end as ope, avg(prompt_accuracy) as online
  from draws d join ranked x on x.name = d.name and x.at = d.pick join tops t on t.name = d.name group by {", ".join("x." + c.strip() for c in P.split(","))}, estimator, rep),
ci as (select {P}, estimator, {", ".join(f"quantile_cont({x}, {q}) as {n}_ci_{s}" for n, x in (("ope", "ope"), ("online", "online"), ("signed_error", "ope - online"), ("absolute_error", "abs(ope - online)")) for s, q in (("low", 0.025), ("high", 0.975)))},
  0e0 as bootstrap_nonfinite_fraction, count(*) as bootstrap_reps from reps group by {P}, estimator)"""


def candidates() -> str:
    """Rows of the candidate grids: those of 40 to 80 pairs over three seeds, numbered by pattern and size."""
    made = [(n, lags) for lags in LAG_PATTERNS.values() for n in range(1, 13) if 40 <= 3 * (len(IDENTITY_STEPS) + n + len(ROLLING_ANCHORS) * len(lags)) <= 80]
    return ", ".join(f"('C{i:03d}', {list(spaced_targets(n))}, {list(lags)})" for i, (n, lags) in enumerate(made, 1))


ORACLES: dict[str, str] = {
    "exact_percentiles": w(STATS, f"select {P}, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) + 0e0 as {c}_{n}" for c in SELECTED for n, q in SHARES.items()) + f" from ps group by {P}"),
    "exact_weight_moments": w(STATS, f'select {P}, prompt_id, "K", {rounds("mean_log_weight sd_log_weight mean_abs_log_weight", 9)} from ps'),
    "exact_estimates": w(STATS, estimates(), f"""g as (select *, max(log_weight) over (partition by {P}) as top from fx_rescores)""", f"""select {P}, estimator, round(estimate, 9) + 0e0 as estimate from est
  union all select {P}, 'global_wis', round(coalesce(sum(case when correctness_reward = 1 then exp(log_weight - top) end) / sum(exp(log_weight - top)), 0e0), 9) + 0e0 from g group by {P}"""),
    "cancelling_sums": "select l_returnflag, l_linestatus, 3 * count(*) as n, sum(l_quantity / 1024e0) as total from lineitem group by 1, 2",
    "pooled_ranks": w(STATS, f"select {P}, prompt_id, mean_completion_length, reward_rate, " + ", ".join(f"rank() over (partition by split order by {v}) + (count(*) over (partition by split, {v}) - 1) / 2 as rank_{v}" for v in ("mean_completion_length", "reward_rate")) + " from ps"),
    "bootstrap_blocks": w(MATCHED, blocks(True), f"select {P}, estimator, {CI}, bootstrap_reps from ci"),
    "bootstrap_blocks_unpaired": w(MATCHED, blocks(False), f"select {P}, estimator, {CI}, bootstrap_reps from ci"),
    "snapshot_versions": """with v as (
  select 1 as version, * from orders where o_orderkey % 2 = 0 union all select 2, * from orders
  union all select 3, * from orders where o_orderstatus <> 'F' or o_orderkey % 3 = 0 union all select 4, * from orders where o_totalprice > 100000)
select cast(version as bigint) as version, o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, round(sum(o_totalprice), 2) as price from v group by 1, 2""",
    "ingested_events": "select event_type, count(*) as n, count(distinct event_id) as n_keys, max(cast(cast(ts as date) as varchar)) as last, (select count(*) from events) as n_units from events group by 1",
    "scope_hash_states": "select l_returnflag, count(*) as n_rows, true as same_as_whole, true as same_rows from lineitem where l_orderkey % 5 > 0 group by 1",
    "grid_members": w(FULL, f"c(candidate_id, targets, lags) as (values {candidates()})", """select candidate_id, purpose, split, count(*) as n, cast(sum(target_step) as bigint) as targets from res join c
  on (purpose = 'fixed' and list_contains(c.targets, target_step)) or (purpose = 'rolling' and list_contains(lags, target_step - behavior_step)) where estimator = 'prompt_wis' group by 1, 2, 3"""),
}
