COST = """costs as (select u.*, u.input_tokens * coalesce(p.p_in, 1) / 1e6 + u.output_tokens * coalesce(p.p_out, 5) / 1e6 as cost
  from usage_log u left join price_table p on p.model = u.model)"""
SPENT = """spent as (select coalesce(sum(cost), 0) as s from costs where date_trunc('month', created_at) = date_trunc('month', timestamp '2024-01-20 12:00:00'))"""
MOVED = """moved as (select job_id, state as old_state, case
  when pipeline_steps = 'discover_only' and state in ('draft', 'paused') then 'queued'
  when pipeline_steps = 'discover_apply' and state in ('queued', 'running') then 'paused'
  when pipeline_steps = 'full' and state in ('draft', 'queued', 'running', 'paused') then 'cancelled' else state end as state,
  pipeline_steps = 'discover_only' and state in ('draft', 'paused') as requeued from jobs)"""
OUTCOME = """outcomes as (
  select w.job_id, w.product_id, case when error is null then 1 else 0 end as success, case when error is null then 0 else 1 end as failure,
    case when error is not null then 0 when j.pipeline_steps <> 'normalize_only' then w.white_bg when p.has_main_image and w.was_white_bg and not w.skipped_unchanged then 1 else 0 end as white_bg,
    case when error is not null then 0 when j.pipeline_steps <> 'normalize_only' then w.rembg when p.has_main_image and not (w.was_white_bg and not w.skipped_unchanged) then 1 else 0 end as rembg,
    case when error is not null then 'error' end as product_state, left(error, 5000) as err
  from work_results w join jobs j on j.job_id = w.job_id join products p on p.product_id = w.product_id)"""


def _ticks(weeks: int = 5, jobs: int = 3, products: int = 5) -> str:
    """The job loop written out tick by tick; every tick reads what the one before it left."""
    parts = [COST, OUTCOME, """log as materialized (select c.*, cast(floor((day(created_at) - 1) / 7) as int) as week from costs c)""",
             """plan as materialized (select round(coalesce(sum(cost), 0) * 0.85, 2) as budget from log)""",
             """j0 as materialized (select job_id, state, pipeline_steps, created_at, success_count, failure_count, processed_count,
  0 as white, 0 as rembg, 0.0::double as paid, null::timestamp as started, null::timestamp as completed from jobs)""",
             "p0 as materialized (select job_id, product_id from job_products where pending)"]
    for k in range(1, weeks + 1):
        parts.append(f"""t{k} as materialized (select (select max(created_at) from log where week = {k - 1}) as now, budget,
  (select coalesce(sum(cost), 0) from log where week < {k} and date_trunc('month', created_at) = (select date_trunc('month', max(created_at)) from log where week = {k - 1})) as spent from plan),
b{k} as materialized (select j.* replace (case when now is not null and spent >= budget and state in ('queued', 'running') then 'paused' else state end as state), now, spent, budget from j{k - 1} j, t{k}),
c{k} as materialized (select job_id from b{k} where state in ('queued', 'running') and now is not null order by created_at, job_id limit {jobs}),
w{k} as materialized (select o.* from outcomes o join (select job_id, product_id, row_number() over (partition by job_id order by product_id) as place
  from p{k - 1} where job_id in (select job_id from c{k})) p on p.job_id = o.job_id and p.product_id = o.product_id where place <= {products}),
p{k} as materialized (select * from p{k - 1} p where not exists (select 1 from w{k} w where w.job_id = p.job_id and w.product_id = p.product_id)),
j{k} as materialized (select b.job_id, case when c.job_id is null then state when l.n is null then 'done' else 'running' end as state, pipeline_steps, created_at,
  success_count + coalesce(s, 0) as success_count, failure_count + coalesce(f, 0) as failure_count, processed_count + coalesce(a.n, 0) as processed_count,
  white + coalesce(wb, 0) as white, rembg + coalesce(rb, 0) as rembg, paid + coalesce(u.cost, 0) as paid,
  case when c.job_id is not null and state = 'queued' then coalesce(started, now) else started end as started,
  case when c.job_id is not null and l.n is null then now else completed end as completed
  from b{k} b left join c{k} c on c.job_id = b.job_id
  left join (select job_id, sum(success) as s, sum(failure) as f, count(*) as n, sum(white_bg) as wb, sum(rembg) as rb from w{k} group by job_id) a on a.job_id = b.job_id
  left join (select job_id, count(*) as n from p{k} group by job_id) l on l.job_id = b.job_id
  left join (select job_id, sum(cost) as cost from log where week = {k - 1} group by job_id) u on u.job_id = b.job_id)""")
    told = " union all ".join(
        f"select case when spent >= budget then 'Budget exhausted' else 'Budget at 80% (' end as said from t{k} where budget > 0 and spent >= 0.8 * budget "
        f"and (spent < budget or exists (select 1 from j{k - 1} where state in ('queued', 'running')))" for k in range(1, weeks + 1))
    return f"""with {", ".join(parts)}
select job_id, state, success_count::bigint as success_count, failure_count::bigint as failure_count, processed_count::bigint as processed_count,
  white::bigint as white_bg_count, rembg::bigint as rembg_count, round(paid, 6) as actual_cost_usd, started as started_at, completed as completed_at,
  (select max(said) from ({told})) as last_alert from j{weeks}"""


ORACLES = {
    "job_transition": f"with {MOVED} select job_id, old_state, state, requeued from moved",
    "job_requeue": f"""with {MOVED}
select jp.job_id, jp.product_id, coalesce(m.requeued, false) or jp.pending as pending from job_products jp left join moved m on m.job_id = jp.job_id""",
    "job_pick": "select job_id, state, created_at from jobs where state in ('queued', 'running') order by created_at, job_id limit 3",
    "job_chunk": """
select job_id, product_id, cast(place as int) as place from (
  select job_id, product_id, row_number() over (partition by job_id order by product_id) as place from job_products where pending) where place <= 5""",
    "job_outcome": f"""with {OUTCOME}
select job_id, product_id, cast(success as int) as success, cast(failure as int) as failure, cast(white_bg as int) as white_bg, cast(rembg as int) as rembg,
  product_state, md5(err) as product_error from outcomes""",
    "job_progress": f"""with {OUTCOME}, {COST},
paid as (select job_id, sum(cost) as paid from costs group by job_id),
chunk as (select job_id, product_id from (select job_id, product_id, row_number() over (partition by job_id order by product_id) as place from job_products where pending) where place <= 5),
agg as (select o.job_id, sum(success) as s, sum(failure) as f, count(*) as n, sum(white_bg) as w, sum(rembg) as r
  from outcomes o join chunk c on c.job_id = o.job_id and c.product_id = o.product_id group by o.job_id),
lefts as (select p.job_id, count(*) as n from job_products p where pending and not exists (
  select 1 from outcomes o join chunk c on c.job_id = o.job_id and c.product_id = o.product_id join jobs r on r.job_id = o.job_id and r.state in ('queued', 'running')
  where o.job_id = p.job_id and o.product_id = p.product_id) group by p.job_id),
j as (select j.*, a.*  exclude (job_id), coalesce(l.n, 0) as pend, a.n is not null and j.state in ('queued', 'running') as ran
  from jobs j left join agg a on a.job_id = j.job_id left join lefts l on l.job_id = j.job_id)
select job_id, case when ran and pend = 0 then 'done' when ran then 'running' else state end as state,
  cast(success_count + case when ran then s else 0 end as bigint) as success_count, cast(failure_count + case when ran then f else 0 end as bigint) as failure_count,
  cast(processed_count + case when ran then n else 0 end as bigint) as processed_count,
  cast(case when ran then w else 0 end as bigint) as white_bg_count, cast(case when ran then r else 0 end as bigint) as rembg_count,
  round(coalesce(paid, 0), 6)::double as actual_cost_usd,
  case when ran and state = 'queued' then timestamp '2024-01-20 12:00:00' end as started_at,
  case when ran and pend = 0 then timestamp '2024-01-20 12:00:00' end as completed_at,
  cast(case when ran then w else 0 end as bigint) as white_bg_added, cast(case when ran then r else 0 end as bigint) as rembg_added, pend as pending_left
from j left join paid using (job_id)""",
    "job_close_empty": """
select job_id, case when state in ('queued', 'running') and job_id not in (select job_id from job_products where pending) then 'done' else state end as state from jobs""",
    "job_total_count": "select l_orderkey as job_id, count(distinct l_partkey) as total_count from lineitem group by l_orderkey",
    "usage_cost": f"with {COST} select usage_id, model, round(cost, 9) as cost_usd from costs",
    "usage_month_to_date": f"with {COST}, {SPENT} select round(s, 6) as spent_usd from spent",
    "job_spend": f"with {COST} select job_id, round(sum(cost), 6) as actual_cost_usd from costs group by job_id",
    "budget_decision": f"""with {COST}, {SPENT}
select job_id, case when s >= 50 and state in ('queued', 'running') then 'paused' else state end as state,
  case when s >= 50 then 'exhausted' when s >= 40 then 'warning' else 'none' end as budget_alert from jobs, spent""",
    "alert_rows": f"""with {COST}, {SPENT}
select 'ops@example.com' as email_to, concat(case when s >= 50 then 'Budget exhausted, jobs paused ' else 'Budget at 80% ' end, '($', printf('%.2f', s), '/$50.00)') as subject,
  case when s >= 50 then 'All running jobs have been paused. Resume them after raising the budget.' else 'Monthly spend has reached 80% of the budget.' end as body
from spent where s >= 40 and (s < 50 or exists (select 1 from jobs where state in ('queued', 'running')))""",
    "job_log_view": """
select s.job_id, log_id, s.created_at, step, level, duration_ms from step_log s where s.job_id in (select job_id from jobs) order by job_id, created_at desc, log_id desc""",
    "usage_log_view": f"with {COST} select usage_id, created_at, model, operation, round(cost, 9) as cost_usd from costs order by created_at desc, usage_id desc",
    "job_list_view": f"""with {COST}
select j.job_id, j.state, j.pipeline_steps, j.created_at, coalesce(n, 0) as total_count, round(coalesce(c, 0), 6) as actual_cost_usd
from jobs j left join (select job_id, count(*) as n from job_products group by job_id) a on a.job_id = j.job_id
left join (select job_id, sum(cost) as c from costs group by job_id) b on b.job_id = j.job_id order by j.created_at desc, j.job_id desc""",
    "stream_usage_budget": f"""with {COST}
select cast(date_trunc('month', created_at) as timestamp) as month, round(sum(cost), 6) as spent_usd, count(*) as n_calls from costs group by 1""",
    "stream_job_ticks": _ticks(),
    "stream_budget_alerts": f"""with {COST},
plan as (select round(coalesce(sum(cost), 0) * 0.85, 2) as budget from costs),
weeks as (select date_trunc('month', created_at) as month, cast(floor((day(created_at) - 1) / 7) as int) as week, sum(cost) as c from costs group by 1, 2),
sums as (select month, week, sum(c) over (partition by month order by week) as s, budget from weeks, plan),
told as (select month, 'warning' as level, arg_min(s, week) as s from sums where budget > 0 and s >= 0.8 * budget group by month
  union all select month, 'exhausted', arg_min(s, week) from sums where budget > 0 and s >= budget group by month)
select cast(month as timestamp) as month, level, round(s, 6) as spent_usd from told""",
}
