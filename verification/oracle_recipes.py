from verification.oracle_candidates import BASE, FOLDER, PARENT
from verification.oracle_discovery import HOST

READY = f"pg as (select c.page_id, c.url, c.status, c.content_type, c.html, r.* from crawl_pages c join recipes r on r.domain = {HOST} where r.recipe_built and r.active)"
EVENT_AT = "strftime(event_ts, '%Y%m%d%H%M%S.%f') || lpad(cast(event_id as string), 12, '0')"

ORACLES = {
    "recipe_lookup": f"with {READY} select page_id, url, domain, main_image_selector from pg",
    # the gallery holds fixed shapes, so the result can be written down per page
    "recipe_extract": f"""
with {READY}, usable as (
  select page_id, url, length(domain) % 3 = 0 as lazy, page_id % 5 <> 0 as wide, {BASE} from pg
  where status = 200 and contains(lower(content_type), 'html') and not contains(lower(html), 'checking your browser')
), shots as (
  select *, concat(origin, '/img/', cast(page_id as string), '_main.jpg') as hero, concat(sch, '://cdn.example.com/', cast(page_id as string), '_b.png') as lazy_png,
    concat(origin, {FOLDER}, 'detail.jpg') as detail, concat(origin, {PARENT}, 'up/', cast(page_id as string), '.webp?w=1&h=2') as webp
  from usable
), listed as (
  select page_id, case when lazy then (case when wide then [webp, hero, lazy_png, detail] else [hero, lazy_png] end) else (case when wide then [hero, detail, webp] else [hero] end) end as urls,
    not lazy or wide as has_main from shots
), flat as (select page_id, has_main, unnest(urls) as url, unnest(range(len(urls))) as pos from listed)
select page_id, cast(pos as int) as pos, url, case when pos = 0 and has_main then 'main' else 'angle' end as role,
  case when pos = 0 and has_main then 0.9e0 else 0.85e0 end as confidence from flat""",
    "recipe_upsert": """
select * exclude (written_at) from recipes union all
select domain, 0, false, 0, true, null, null, 'src', null from learned_domains where domain not in (select domain from recipes)""",
    "recipe_success_counts": """
with g as (select regexp_extract(page_url, '^https://([^/]*)', 1) as domain, count(*) as n from product_runs where created_any and not via_recipe group by 1)
select coalesce(g.domain, l.domain) as domain, coalesce(n, 0) as success_count from learned_domains l full outer join g on g.domain = l.domain""",
    "recipe_failure_state": """
with k as (select concat('d', cast(c_custkey as string), '.example.com') as domain, c_nationkey % 4 as cf, c_nationkey > 3 as built, c_acctbal > 0 as act from customer),
f as (select domain, count(*) as n, max(event_ts) as last from recipe_events where outcome = 'failure' group by domain)
select k.domain, cf + coalesce(n, 0) as consecutive_failures, built and not (n is not null and cf + n >= 3) as recipe_built,
  act and not (n is not null and cf + n >= 3) as active, f.last as last_failure
from k left join f on f.domain = k.domain""",
    "recipe_success_reset": """
with e as (select domain, outcome, event_ts, event_id, row_number() over (partition by domain order by event_ts, event_id) as rn from recipe_events),
s as (select domain, max(rn) as rn, max(event_ts) as ts from e where outcome = 'success' group by domain)
select e.domain, count(case when e.outcome = 'failure' and e.rn > coalesce(s.rn, 0) then 1 end) as consecutive_failures, any_value(s.ts) as last_validated
from e left join s on s.domain = e.domain group by e.domain""",
    "recipe_build_due": "select domain, success_count from recipes where active and not recipe_built and success_count >= 5",
    "recipe_evidence": """
with d as (select domain from learned_domains union all select 'BRAND1' union all select 'product/77'),
c as (select d.domain, c.*, row_number() over (partition by d.domain order by created_at desc, candidate_id) as place
  from d join candidates c on c.source_page_url ilike concat('%', d.domain, '%') where c.state in ('approved', 'applied')),
l as (select *, min(place) over (partition by domain, source_page_url) as fst from c where place <= 20),
p as (select domain, source_page_url, fst, count(*) as n,
  concat('[', string_agg(concat('{"url":"', source_url, '","role":"', role, '"}'), ',' order by place), ']') as js from l group by domain, source_page_url, fst),
q as (select *, row_number() over (partition by domain order by fst) as page_no, sum(n) over (partition by domain) as rows_n, count(*) over (partition by domain) as pages_n from p)
select domain, cast(page_no as int) as page_no, source_page_url as page_url, n as n_images, js as images_json from q where page_no <= 5 and rows_n >= 5 and pages_n >= 5""",
    "recipe_ingest": """
with o as (select domain, regexp_extract(text, '(?s)\\{.*\\}') as o from recipe_answers), r as (
  select domain, coalesce(json_extract_string(o, '$.main_image_selector'), '') as main_image_selector, coalesce(json_extract_string(o, '$.gallery_image_selector'), '') as gallery_image_selector,
    coalesce(json_extract_string(o, '$.image_url_attribute'), 'src') as image_url_attribute, coalesce(json_extract_string(o, '$.excluded_url_patterns'), '') as excluded_url_patterns,
    coalesce(json_extract_string(o, '$.notes'), '') as notes, o as raw_recipe_json, timestamp '2024-03-01 12:00:00' as last_built from o where o <> '')
select *, main_image_selector <> '' or gallery_image_selector <> '' as recipe_built from r""",
    "recipe_order": "select domain, success_count, strftime(written_at, '%Y-%m-%d') as written_on from recipes order by success_count desc, written_at desc, domain",
}
