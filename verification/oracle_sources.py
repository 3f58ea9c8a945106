ITEMS = """select product_id, provider, cast(i as int) as rank, json_extract_string(body, concat('$.{path}[', cast(i as string), '].{url}')) as url,
 coalesce(json_extract_string(body, concat('$.{path}[', cast(i as string), '].title')), '') as title,
 coalesce(json_extract_string(body, concat('$.{path}[', cast(i as string), '].{snippet}')), '') as snippet
from (select product_id, provider, body, unnest(range(cast(json_array_length(body, '$.{path}') as bigint))) as i from search_bodies where provider = '{provider}')"""
BRAVE = ITEMS.format(path="web.results", url="url", snippet="description", provider="brave")
SERP = ITEMS.format(path="organic_results", url="link", snippet="snippet", provider="serpapi")
CSE = ITEMS.format(path="items", url="link", snippet="snippet", provider="google_cse")
DDG = """select product_id, provider, cast(i as int) as rank, regexp_extract(a, 'href="([^"]*)"', 1) as url, regexp_extract(a, '>([^<]*)<', 1) as title, '' as snippet
from (select product_id, provider, unnest(range(least(10, len(al)))) as i, unnest(al[1:10]) as a from (
  select product_id, provider, list_filter(regexp_extract_all(body, '<a [^>]*>[^<]*</a>'), lambda x: contains(x, 'result__a')) as al
  from search_bodies where provider in ({names})))
where regexp_extract(a, 'href="([^"]*)"', 1) <> ''"""
JSON_TEXT = """regexp_extract(text, '(?s)\\{.*\\}')"""
LOCS = """select sitemap_url, cast(unnest(range(len(l))) as int) as pos, unnest(l) as loc from (
  select sitemap_url, list_filter(list_transform(regexp_extract_all(body, '<loc>([^<]*)</loc>', 1), lambda s: replace(trim(s), '&amp;', '&')), lambda s: s <> '') as l
  from sitemap_bodies where body like '%</{root}>')"""

ORACLES = {
    "scan_images": """
with recursive files as (select image_id, octet_length(content) as n, hex(content) as x from image_blobs),
walk as (select image_id, 5 as p from files where x like 'FFD8FF%'
  union all
  select w.image_id, case when substr(x, p + 2, 2) = 'FF' then p + 2 else p + 4 + 2 * cast(concat('0x', substr(x, p + 4, 4)) as int) end
  from walk w join files f on f.image_id = w.image_id
  where substr(x, p, 2) = 'FF' and length(substr(x, p + 4, 4)) = 4 and not regexp_matches(substr(x, p + 2, 2), 'C[0-35-79ABDEF]|D9|DA')),
frames as (select f.image_id, cast(concat('0x', substr(x, p + 14, 4)) as int) as w, cast(concat('0x', substr(x, p + 10, 4)) as int) as h
  from walk k join files f on f.image_id = k.image_id where regexp_matches(substr(x, p, 4), 'FFC[0-35-79ABDEF]')),
le as (select *, x[1:8] = '52494646' and x[17:24] = '57454250' as webp, x[25:32] as kind from files),
sized as (select le.*, case when x[1:6] = '89504E' then 'png' when x[1:6] = 'FFD8FF' then 'jpeg' when x[1:6] = '474946' then 'gif' when webp then 'webp' end as format,
  case when x[1:6] = '89504E' then cast(concat('0x', x[33:40]) as int) when x[1:6] = 'FFD8FF' then fr.w when x[1:6] = '474946' then cast(concat('0x', x[15:16], x[13:14]) as int)
    when kind = '56503858' then cast(concat('0x', x[53:54], x[51:52], x[49:50]) as int) + 1 when kind = '56503820' then cast(concat('0x', x[55:56], x[53:54]) as int) & 16383
    when kind = '5650384C' then (cast(concat('0x', x[49:50], x[47:48], x[45:46], x[43:44]) as bigint) & 16383) + 1 end as width,
  case when x[1:6] = '89504E' then cast(concat('0x', x[41:48]) as int) when x[1:6] = 'FFD8FF' then fr.h when x[1:6] = '474946' then cast(concat('0x', x[19:20], x[17:18]) as int)
    when kind = '56503858' then cast(concat('0x', x[59:60], x[57:58], x[55:56]) as int) + 1 when kind = '56503820' then cast(concat('0x', x[59:60], x[57:58]) as int) & 16383
    when kind = '5650384C' then ((cast(concat('0x', x[49:50], x[47:48], x[45:46], x[43:44]) as bigint) >> 14) & 16383) + 1 end as height
  from le left join frames fr on fr.image_id = le.image_id)
select image_id, n as n_bytes, format, cast(width as int) as width, cast(height as int) as height,
  coalesce(width > 0 and height > 0 and case format when 'png' then x like '%49454E44AE426082' when 'webp' then cast(concat('0x', x[15:16], x[13:14], x[11:12], x[9:10]) as bigint) + 8 <= n else true end, false) as readable
from sized""",
    "scan_sitemap_urls": LOCS.format(root="urlset"),
    "scan_sitemap_index": LOCS.format(root="sitemapindex"),
    "scan_search_brave": BRAVE,
    "scan_search_serpapi": SERP,
    "scan_search_cse": CSE,
    "scan_search_ddg": DDG.format(names="'ddg', 'other'"),
    "search_dispatch": f"{BRAVE} union all {SERP} union all {CSE} union all {DDG.format(names=repr('ddg') + ', ' + repr('other'))}",
    "scan_llm_response": f"""
with raw as (select response_id, {JSON_TEXT} as o from llm_responses), j as (select response_id, case when o = '' then null else o end as o from raw)
select response_id, o is null as parse_error, coalesce(json_extract_string(o, '$.page_is_correct_product') = 'true', false) as page_is_correct_product,
  coalesce(cast(json_extract_string(o, '$.product_match_confidence') as double), 0e0) as product_match_confidence,
  cast(coalesce(json_array_length(o, '$.images'), 0) as int) as n_images,
  cast(coalesce(json_array_length(o, '$.rejected'), 0) as int) as n_rejected,
  coalesce(array_to_string(list_transform(json_extract_string(nullif(o, ''), '$.images[*].role'), lambda x: coalesce(x, '-')), ','), '') as roles
from j""",
    "settings_typed": """
with w as (select scope_id, max(case when name = 'white_threshold' then value end) as a, max(case when name = 'white_bg_min_percent' then value end) as b,
  max(case when name = 'min_confidence' then value end) as c, max(case when name = 'strict_white_main' then value end) as d,
  max(case when name = 'output_format' then value end) as e, max(case when name = 'brand_attribute_name' then value end) as f,
  max(case when name = 'max_images_per_product' then value end) as g, max(case when name = 'overwrite_existing_main' then value end) as h,
  max(case when name = 'request_delay_seconds' then value end) as k from setting_rows group by scope_id)
select scope_id, coalesce(try_cast(a as int), 245) as white_threshold, coalesce(try_cast(b as int), 85) as white_bg_min_percent,
  coalesce(try_cast(c as double), 0.7e0) as min_confidence, case when d is null then true else lower(d) in ('1', 'true', 't', 'yes') end as strict_white_main,
  coalesce(e, 'jpeg') as output_format,
  '' as classifier_api_key, 'small' as classifier_model, 'brave' as search_provider, '' as search_api_key, '' as removal_api_key, '' as render_api_key,
  '' as render_endpoint, true as recipe_cache_enabled, coalesce(f, 'Brand') as brand_attribute_name, true as strict_brand_url_match, 1920 as target_canvas_size,
  8 as padding_percent, '#FFFFFF' as bg_color, 92 as jpeg_quality, true as force_normalize_existing, coalesce(try_cast(g as int), 4) as max_images_per_product,
  600 as min_image_width, 'birefnet-general' as removal_model, case when h is null then false else lower(h) in ('1', 'true', 't', 'yes') end as overwrite_existing_main,
  true as require_review, 'ProductImageBot/1.0' as user_agent, coalesce(try_cast(k as double), 2e0) as request_delay_seconds, 2 as concurrent_workers,
  50e0 as monthly_budget_usd, '' as alert_email, true as keep_backup from w""",
    "settings_save": """
with ch as (select c_custkey as scope_id, name, cast(c_nationkey + 200 as string) as value
  from customer, (select 'white_threshold' as name union all select 'padding_percent' union all select 'bg_color') k where c_mktsegment = 'BUILDING')
select coalesce(ch.scope_id, s.scope_id) as scope_id, coalesce(ch.name, s.name) as name, case when ch.scope_id is not null then ch.value else s.value end as value
from setting_rows s full outer join ch on ch.scope_id = s.scope_id and ch.name = s.name""",
    "sink_candidates": """
select candidate_id, product_id, job_id, role, confidence, source_url, source_page_url, case when role = 'main' then 'hero shot' else '' end as ai_reasoning,
  image_width, image_height, cast(image_width * image_height // 1024 as int) as image_filesize_kb, case when role = 'uncertain' then '' else 'image/jpeg' end as image_mimetype,
  has_white_background, case when has_white_background then 97.5e0 else 12.5e0 end as background_white_percent, created_at, 'pending' as state from candidates""",
    "sink_step_log": """
select log_id, job_id, step, level, cast(length(left(message, 5000)) as int) as message_length, md5(left(message, 5000)) as message_md5 from step_log""",
    "sink_usage_log": """
with u as (select usage_id, model, operation, case when duration_ms >= 30 then input_tokens else 0 end as input_tokens,
  case when error is null then output_tokens else 0 end as output_tokens from usage_log)
select usage_id, u.model, input_tokens, output_tokens, operation,
  cast(cast(input_tokens * coalesce(p_in, 1) / 1e6 + output_tokens * coalesce(p_out, 5) / 1e6 as decimal(12,6)) as double) as cost_usd
from u left join price_table p on p.model = u.model""",
    "sink_product_updates": """
with n as (select product_id, count(*) as k from candidates where state = 'applied' and role = 'main' group by product_id)
select p.product_id, case when p.product_id % 10 = 3 then null when p.product_id % 4 = 1 then 'late' else p.name end as name,
  case when n.k is not null then 'enriched' when p.product_id % 4 = 1 then 'late' else p.enrichment_state end as enrichment_state,
  case when n.k > 5 then true else p.main_image_normalized end as main_image_normalized
from products p left join n on n.product_id = p.product_id""",
}
