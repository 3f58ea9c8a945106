"""Relations of the catalog-imagery model, derived from the sample star schema.

Each entry is one SELECT over the sample tables or over earlier entries. The
text runs in Spark and in DuckDB; three spellings that differ between the two
are rewritten by ``for_duckdb``. No statement uses a window without a bounded
group, a row cap or a key filter: every relation grows with its input.
"""

from __future__ import annotations

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_BRAND_HOST = (
    "concat(case when p_brand like '%3' then lower(replace(p_brand,'#','-')) "
    "else lower(replace(p_brand,'#','')) end, '.com')"
)
_ID = "cast({} as string)"

DERIVED: dict[str, str] = {}

DERIVED["categories"] = """
select r_regionkey + 100 as category_id, r_name as name, cast(null as int) as parent_id,
       r_regionkey % 2 = 0 as enable_gallery from region
union all
select n_nationkey, n_name, n_regionkey + 100, n_nationkey % 2 = 0 from nation
"""

DERIVED["products"] = """
select p_partkey as product_id, p_name as name, concat('SKU-', cast(p_partkey as string)) as default_code,
       case when p_partkey % 11 = 0 then ' Acme Co ' when p_partkey % 13 = 0 then '  ' end as manufacturer_override,
       case when p_partkey % 7 = 0 then concat('M-', cast(p_partkey as string)) end as manufacturer_sku,
       case when p_size < 48 then p_size % 25 end as category_id,
       p_size % 5 <> 0 as is_published, p_partkey % 4 <> 0 as has_main_image,
       (p_partkey % 4 <> 0 and p_partkey % 3 = 0) as main_image_normalized,
       (p_partkey % 4 <> 0 and p_partkey % 6 = 0) as main_image_already_white_bg,
       case p_partkey % 3 when 0 then 'auto' when 1 then 'yes' else 'no' end as gallery_mode,
       case p_partkey % 6 when 0 then 'enriched' when 1 then 'candidates_found'
            when 2 then 'no_results' else 'not_enriched' end as enrichment_state,
       case when p_partkey % 4 <> 0 then concat('bytes:', p_name, cast(p_partkey as string)) end as main_image_text,
       case when p_partkey % 12 = 3 then concat('orig:', cast(p_partkey as string)) end as original_image_text
from part
"""

DERIVED["attribute_lines"] = """
select p_partkey as product_id, 0 as line_no,
       case when p_partkey % 2 = 0 then ' brand ' else 'Brand' end as attribute_name, 0 as value_no,
       case when p_partkey % 5 <> 0 then replace(p_brand, '#', ' ') end as value_name from part
union all
select p_partkey, 1, 'Size', 0, cast(p_size as string) from part
union all
select p_partkey, 2, 'BRAND', 0, case when p_partkey % 10 = 0 then concat('Alt ', p_brand) end from part
"""

DERIVED["gallery_images"] = """
select p_partkey as product_id, concat(p_name, ' - angle') as name, 10 as sequence from part where p_size > 25
union all
select p_partkey, concat(p_name, ' - detail'), 20 from part where p_retailprice > 950
"""

DERIVED["candidates"] = """
select concat('c', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
              cast(l_suppkey as string), '-', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as candidate_id,
       l_partkey as product_id, l_suppkey as job_id,
       case l_linenumber when 1 then 'main' when 2 then 'angle' when 3 then 'detail' when 4 then 'in_use'
            when 5 then 'lifestyle' when 6 then 'accessory' else 'uncertain' end as role,
       round(1.0e0 - l_discount * 5, 2) as confidence,
       case when l_returnflag = 'N' and l_linestatus = 'O' then 'pending' when l_returnflag = 'N' then 'approved'
            when l_returnflag = 'A' then 'applied' else 'rejected' end as state,
       concat('https://cdn.brand', cast(l_suppkey % 25 as string), '.example.com/p/', cast(l_partkey as string), '_',
              cast(l_linenumber as string), '.jpg') as source_url,
       concat('https://www.brand', cast(l_suppkey % 25 as string), '.example.com/product/', cast(l_partkey as string)) as source_page_url,
       cast(400 + l_quantity * 20 as int) as image_width, cast(300 + l_quantity * 10 as int) as image_height,
       l_tax > 0.03 as has_white_background, l_shipdate as created_at
from lineitem
"""

DERIVED["usage_log"] = """
select event_id as usage_id, ts as created_at,
       case event_id % 4 when 0 then 'small' when 1 then 'medium' when 2 then 'large' else 'unlisted' end as model,
       (user_id * 37) % 5000 as input_tokens, (user_id * 13 + event_id) % 700 as output_tokens,
       event_id % 10 as job_id, user_id as product_id,
       case when event_type = 'view' then 'vision_studio_check' else 'classify_images' end as operation,
       case when event_type = 'error' then 'call failed' end as error, event_id % 900 as duration_ms
from events
"""

DERIVED["price_table"] = """
select 'small' as model, 1.0e0 as p_in, 5.0e0 as p_out
union all select 'medium', 3.0e0, 15.0e0
union all select 'large', 15.0e0, 75.0e0
"""

DERIVED["step_log"] = """
select event_id as log_id, ts as created_at, event_id % 10 as job_id, user_id as product_id,
       case event_type when 'click' then 'fetch_page' when 'view' then 'classify' when 'signup' then 'download_image'
            when 'purchase' then 'apply' else 'error' end as step,
       case when event_type = 'error' then 'error' when event_id % 7 = 0 then 'warning' else 'info' end as level,
       repeat(concat(event_type, ' ', props, ' '), cast(case when event_id % 40 = 0 then 200 + user_id else 1 + event_id % 5 end as int)) as message,
       event_id % 900 as duration_ms
from events
"""

DERIVED["jobs"] = """
select o_orderkey as job_id,
       case o_orderstatus when 'F' then case when o_orderpriority = '1-URGENT' then 'paused' else 'done' end
            when 'O' then case when o_orderpriority = '5-LOW' then 'draft' else 'queued' end else 'running' end as state,
       case o_orderkey % 4 when 0 then 'discover_only' when 1 then 'discover_apply' when 2 then 'normalize_only' else 'full' end as pipeline_steps,
       cast(o_custkey % 7 as int) as processed_count, cast(o_custkey % 5 as int) as success_count,
       cast(o_custkey % 2 as int) as failure_count, o_totalprice as estimated_cost_usd, o_orderdate as created_at
from orders
"""

DERIVED["job_products"] = """
select l_orderkey as job_id, l_partkey as product_id, max(l_quantity) > 10 as pending
from lineitem group by l_orderkey, l_partkey
"""

# what one work chunk reported per product: outcome, error text and image counters
DERIVED["work_results"] = """
select l_orderkey as job_id, l_partkey as product_id,
       case when max(l_linenumber) >= 6 then concat('step failed: ', repeat('x', cast(max(l_quantity) * 150 as int))) end as error,
       cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as int) as white_bg,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as int) as rembg,
       max(l_tax) > 0.04 as was_white_bg, min(l_discount) > 0.02 as skipped_unchanged
from lineitem group by l_orderkey, l_partkey
"""

DERIVED["crawl_pages"] = """
select page_id, url, case when page_id % 13 = 0 then 404 else 200 end as status,
       case when page_id % 10 = 3 then 'application/pdf' else 'text/HTML; charset=utf-8' end as content_type,
       concat(html,
              '<div class="gallery"><img class="hero" src="/img/', cast(page_id as string), '_main.jpg" alt="Part ',
              cast(page_id as string), '" width="800" height="800"><img data-src="//cdn.example.com/',
              cast(page_id as string), '_b.png" width="120" height="90"><img src="thumb/', cast(page_id % 3 as string),
              '.svg">',
              case when page_id % 5 = 0 then '' else concat('<img src="https://cdn.example.com/logo.png" alt="logo"><img src="detail.jpg" width="auto">',
              '<span data-html="<img src=''phantom.jpg''><p>x</p>" hidden></span><image src="no.jpg"></image>',
              '<img class="alt view" src=''../up/./', cast(page_id as string), '.webp?w=1&amp;h=2'' alt='' Side  view '' width=300 height=90>',
              '<img src="" data-src="" data-lazy-src="?img=', cast(page_id as string), '"><img src="/img/', cast(page_id as string), '_main.jpg" alt="again">') end,
              '</div>', case when page_id % 17 = 0 then 'Checking your browser' else '' end) as html
from pages
"""

DERIVED["search_results"] = """
select l_partkey as product_id, cast(l_quantity as int) as rank,
       case l_suppkey % 5 when 0 then concat('https://www.amazon.com/dp/', cast(l_partkey as string))
            when 1 then concat('https://www.', lower(replace(p_brand, '#', '')), '.com/p/', cast(l_partkey as string), '?s=', cast(l_suppkey as string))
            when 2 then concat('https://docs.example.org/', cast(l_partkey as string), '.PDF?v=1')
            when 3 then concat('https://shop', cast(l_linenumber as string), '.example.net/i/', cast(l_partkey as string)) end as url
from lineitem join part on l_partkey = p_partkey
"""

# search response bodies in the four provider formats
DERIVED["search_bodies"] = """
select p_partkey as product_id,
       case p_partkey % 5 when 0 then 'brave' when 1 then 'serpapi' when 2 then 'google_cse' when 3 then 'ddg' else 'other' end as provider,
       case p_partkey % 5
         when 0 then concat('{"web": {"results": [{"url": "https://a.example.com/', cast(p_partkey as string), '", "title": "', p_name,
              '", "description": "d', cast(p_size as string), '"}, {"title": "no url"}, {"url": "https://b.example.com/', cast(p_size as string), '"}]}}')
         when 1 then concat('{"organic_results": [{"link": "https://a.example.com/', cast(p_partkey as string), '", "title": "', p_name,
              '", "snippet": "s"}, {"link": "https://c.example.com/', cast(p_size as string), '", "snippet": "t"}]}')
         when 2 then concat('{"items": [{"link": "https://cse.example.com/', cast(p_partkey as string), '", "title": "', p_name, '"}]}')
         else concat('<div><a class="result__a" href="https://d.example.com/', cast(p_partkey as string), '">', p_name,
              '</a><a class="nav" href="/x">x</a><a rel="nofollow" class="big result__a" href="">blank</a>',
              repeat(concat('<a href="https://e.example.com/', cast(p_size as string), '" class="result__a">t</a>'), 12), '</div>') end as body
from part
"""

_SITEMAP_HEAD = f"""
select p_partkey, p_type, cast(floor(p_partkey / 100) as int) as bucket, {_BRAND_HOST} as host,
       concat('https://', {_BRAND_HOST},
              case when p_brand like '%5' then '/sitemap_index.xml' else '/sitemap.xml' end) as root
from part
"""
DERIVED["sitemap_layout"] = _SITEMAP_HEAD

# rows of parsed sitemaps: brand index -> type index -> bucket file
DERIVED["sitemap_store"] = """
select root as sitemap_url, 'index' as kind, cast(length(p_type) as int) as pos,
       concat('https://', host, '/sitemap-', lower(p_type), '.xml') as loc
from sitemap_layout group by root, host, p_type
union all
select concat('https://', host, '/sitemap-', lower(p_type), '.xml'), 'index', bucket,
       concat('https://', host, '/sitemap-', lower(p_type), '-', cast(bucket as string), '.xml')
from sitemap_layout group by host, p_type, bucket
union all
select concat('https://', host, '/sitemap-', lower(p_type), '-', cast(bucket as string), '.xml'), 'urlset',
       cast(p_partkey % 100 as int),
       concat('https://', host, '/', lower(p_type), '/sku_', cast(p_partkey as string), case when p_partkey % 9 = 0 then '-M_' else '.htm' end, 'l')
from sitemap_layout
"""

DERIVED["sitemap_bodies"] = """
select s_suppkey as file_id, concat('https://supplier', cast(s_suppkey as string), '.example.com/sitemap.xml') as sitemap_url,
       case when s_suppkey % 9 = 4 then '<urlset><url><loc>broken'
            when s_suppkey % 4 = 3 then concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://supplier',
              cast(s_suppkey as string), '.example.com/part-a.xml </loc></sitemap><sitemap><loc>   </loc></sitemap><sitemap><loc>https://supplier',
              cast(s_suppkey as string), '.example.com/part-b.xml.gz</loc></sitemap></sitemapindex>')
            else concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>',
              'https://supplier', cast(s_suppkey as string), '.example.com/p/', cast(s_nationkey as string),
              '</loc><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url><url><loc>  https://supplier', cast(s_suppkey as string),
              '.example.com/q?a=1&amp;b=2 </loc></url></urlset>') end as body
from supplier
"""

DERIVED["hosts"] = """
select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages
"""

DERIVED["robots_rules"] = """
select host, '*' as agent, 0 as ord, false as allow, '/fr/' as path from hosts where length(host) <= 22
union all
select host, '*', 1, true, '/' from hosts where length(host) <= 22
union all
select host, case when length(host) % 2 = 0 then 'ImageBot' else 'OtherBot' end, 2, false,
       case when length(host) % 3 = 1 then '/' else '/de/' end from hosts where length(host) <= 20
"""

DERIVED["resolved_ips"] = """
select host, concat(case length(host) % 6 when 0 then '10.0.0.' when 1 then '169.254.169.' when 2 then '172.20.1.'
       else '93.184.216.' end, cast(length(host) as string)) as ip from hosts where length(host) <> 19
union all
select host, '8.8.8.8' from hosts where length(host) <> 19
union all
select host, case when length(host) % 5 = 0 then '2606:2800:220:1::1' when length(host) % 2 = 0 then 'fe80::1%eth0' else 'fe80::1' end from hosts where length(host) > 21
"""

# outgoing requests, a tenth of them hostile: IP literals, blocked names, other schemes
DERIVED["request_urls"] = """
select event_id as request_id,
       case event_id % 20 when 0 then concat('http://10.', cast(user_id % 256 as string), '.0.7/x')
            when 1 then 'http://169.254.169.254/latest/meta-data' when 2 then 'https://metadata.google.internal/v1'
            when 3 then concat('ftp://files.example.com/', cast(event_id as string))
            when 4 then concat('https://93.184.216.', cast(user_id % 256 as string), ':8443/a')
            when 5 then 'http://[::1]/' when 6 then 'https://[2606:2800:220:1::1]/ok' when 7 then 'http://user:pw@LOCALHOST:80/'
            when 8 then concat('http://198.1', cast(user_id % 10 as string), '.3.4/') when 9 then '/relative/only'
            else concat('https://Host', cast(user_id as string), '.Example.com/', cast(event_id as string)) end as url
from events
"""

DERIVED["fetch_requests"] = """
select event_id as request_id, concat('h', cast(user_id % 20 as string), '.example.com') as host, value as arrival_s from events
"""

DERIVED["downloads"] = """
select candidate_id, source_url as url, case when image_width % 7 = 0 then 404 else 200 end as status,
       case product_id % 4 when 0 then 'image/png' when 1 then 'text/html' when 2 then '' else 'IMAGE/JPEG; q=1' end as content_type,
       (product_id * 7919 + image_width * 104729) % 12000000 as n_bytes, image_width as width
from candidates
"""

_ANSWER_TEXT = """case when (product_id + page_pos) % 6 = 0 then 'Sorry, no JSON here'
            when (product_id + page_pos) % 6 = 1 then '[1, 2]'
            else concat(case when product_id % 3 = 0 then 'Result: ' when product_id % 3 = 1 then '```json ' else '' end,
              '{"page_is_correct_product": ', case when product_id % 5 <> 0 then 'true' else 'false' end,
              ', "product_match_confidence": 0.', cast((product_id + page_pos * 3) % 10 as string),
              ', "match_reasoning": "m", "images": [{"url": "https://cdn.', brand, '.com/', pid, '_a.jpg", "role": "main", "confidence": 0.',
              cast((product_id % 5) + 5 as string), ', "reasoning": "r"}, {"url": "https://img.other.net/', pid,
              '_b.jpg", "role": "angle", "confidence": 0.8, "reasoning": "r"}, {"url": "https://cdn.', brand, '.com/', pid,
              '_c.png", "role": "detail", "confidence": 0.75}, {"url": "https://cdn.', brand, '.com/', pid,
              '_d.jpg", "role": null, "confidence": 0.95, "reasoning": "r"}, {"url": null, "role": "angle", "confidence": 0.99}, {"url": "https://static.', brand, '.com/', pid,
              '_e.jpg", "role": "in_use", "confidence": 0.72}, {"url": "https://cdn.', brand, '.com/', pid,
              '_f.jpg", "role": "main", "confidence": 0.9}, {"url": "https://cdn.', brand, '.com/', pid,
              '_g.jpg", "role": "angle", "confidence": 0.88}], "rejected": [{"url": "https://x.test/', pid, '", "reason": "banner"}]}',
              case when product_id % 3 = 1 then ' ```' when product_id % 3 = 0 then ' (end)' else '' end)"""

DERIVED["llm_responses"] = f"""
select product_id * 3 + page_pos as response_id, product_id, cast(page_pos as int) as page_pos, page_url,
       {_ANSWER_TEXT} end as text
from (
  select p_partkey as product_id, cast(p_partkey as string) as pid, lower(replace(p_brand, '#', '')) as brand, page_pos,
         concat(case when page_pos = 1 then 'https://shop.reseller.net/p/' else concat('https://www.', lower(replace(p_brand, '#', '')), '.com/p/') end,
                cast(p_partkey as string), '?v=', cast(page_pos as string)) as page_url
  from (select p_partkey, p_brand, explode(sequence(0, 2)) as page_pos from part) pp
) x
"""

# every page address that discovery may come upon, with the part it shows
DERIVED["page_addresses"] = """
select a.url, a.part_no, regexp_extract(a.url, '^https://([^/]*)', 1) as domain, lower(replace(p_brand, '#', '')) as brand
from (select loc as url, cast(regexp_extract(loc, 'sku_([0-9]+)', 1) as bigint) as part_no from sitemap_store where kind = 'urlset'
      union all select distinct url, product_id from search_results where url is not null) a join part on p_partkey = a.part_no
"""

DERIVED["page_fetches"] = """
select url, case when part_no % 7 = 3 then 404 else 200 end as status,
       case when part_no % 11 = 5 then 'application/pdf' else 'text/html' end as content_type,
       concat('<html><body><p>Part ', cast(part_no as string), '</p><div class="gallery"><img class="hero" src="https://cdn.', brand, '.com/',
              cast(part_no as string), '_a.jpg"><img src="https://cdn.', brand, '.com/', cast(part_no as string), '_g.jpg"></div>',
              case when part_no % 2 = 0 then repeat('<img src="/x.jpg">', 4) else '' end, '</body></html>') as html
from page_addresses
"""

DERIVED["page_domains"] = """
select distinct domain from page_addresses
"""

DERIVED["page_recipes"] = """
select domain, true as recipe_built, domain like '%.com' as active,
       case when domain like 'www%' then 'img:first' else 'img.hero' end as main_image_selector,
       'div.gallery img' as gallery_image_selector, 'src' as image_url_attribute, '' as excluded_url_patterns
from page_domains where domain like '%1.com' or domain like '%3.com' or domain like 'shop1%'
"""

DERIVED["site_rules"] = """
select domain as host, '*' as agent, 0 as ord, false as allow,
       case when domain like 'shop2%' then '/' when domain like 'brand2%' then '/standard' else '/none' end as path from page_domains
"""

DERIVED["site_ips"] = """
select domain as host, case when domain like 'shop4%' then '10.0.0.9' else '93.184.216.34' end as ip from page_domains where domain not like 'shop5%'
"""

DERIVED["page_answers"] = f"""
select product_id, page_url,
       {_ANSWER_TEXT} end as text
from (select part_no as product_id, cast(part_no as string) as pid, brand, length(url) % 7 as page_pos, url as page_url from page_addresses where length(url) % 13 <> 4) x
"""

# facts measured on downloaded images: transport, size, decode result, background
DERIVED["asset_facts"] = """
select concat(case letter when 'b' then 'https://img.other.net/' when 'e' then concat('https://static.', brand, '.com/')
              else concat('https://cdn.', brand, '.com/') end, cast(p_partkey as string), '_', letter,
              case when letter = 'c' then '.png' else '.jpg' end) as url,
       case when (p_partkey + ascii(letter)) % 19 = 0 then 404 else 200 end as status,
       case ascii(letter) % 3 when 0 then 'image/jpeg' when 1 then '' else 'IMAGE/PNG' end as content_type,
       cast((p_partkey * 7919 + ascii(letter) * 1000003) % 11000000 as bigint) as n_bytes,
       (p_partkey + ascii(letter)) % 23 <> 0 as decodable,
       cast(300 + (p_partkey * 37 + ascii(letter) * 11) % 1500 as int) as width,
       cast(200 + (p_partkey * 17 + ascii(letter)) % 900 as int) as height,
       (p_partkey + ascii(letter)) % 3 = 0 as has_white,
       cast((p_partkey * 13 + ascii(letter)) % 101 as double) as white_percent,
       case when (p_partkey + ascii(letter)) % 3 = 0 then null when p_partkey % 4 = 1 then ' studio.' when p_partkey % 4 = 2 then 'CONTEXT' end as studio_answer
from (select p_partkey, lower(replace(p_brand, '#', '')) as brand, explode(array('a', 'b', 'c', 'd', 'e', 'f', 'g')) as letter from part) p
"""

# pages that stored recipes answered without classification
DERIVED["recipe_hits"] = """
select p_partkey as product_id, cast(p_size % 3 as int) as page_pos,
       concat('https://www.', lower(replace(p_brand, '#', '')), '.com/r/', cast(p_partkey as string)) as page_url,
       concat('https://cdn.', lower(replace(p_brand, '#', '')), '.com/', cast(p_partkey as string), '_a.jpg') as main_url,
       case when p_size > 20 then concat('https://cdn.', lower(replace(p_brand, '#', '')), '.com/', cast(p_partkey as string), '_g.jpg') end as gallery_url
from part where p_size between 10 and 30
"""

DERIVED["recipes"] = """
select host as domain, cast(length(host) % 11 as int) as success_count, length(host) % 2 = 0 as recipe_built,
       cast(length(host) % 4 as int) as consecutive_failures, length(host) % 5 <> 0 as active,
       case when length(host) % 3 = 0 then '.alt.view' else 'img.hero' end as main_image_selector,
       'div.gallery img' as gallery_image_selector,
       case when length(host) % 3 = 0 then 'data-src' else 'src' end as image_url_attribute,
       'thumb, LOGO' as excluded_url_patterns, make_date(2024, cast(1 + length(host) % 12 as int), 15) as written_at
from hosts
"""

# recipe runs per domain over time: 'failure' rows are raised errors, 'success' rows validated runs
DERIVED["recipe_events"] = """
select event_id, ts as event_ts, concat('d', cast(user_id % 40 as string), '.example.com') as domain,
       case when event_type = 'error' then 'failure' when event_type = 'purchase' then 'success' else 'failure' end as outcome
from events where event_type in ('error', 'purchase', 'signup')
"""

DERIVED["learned_domains"] = """
select concat('www.brand', cast(n_nationkey as string), '.example.com') as domain, n_name as note from nation
"""

# successful runs: chosen page per product and whether a stored recipe produced it
DERIVED["product_runs"] = """
select l_orderkey as job_id, l_partkey as product_id,
       concat('https://', case when l_linenumber > 4 then 'new' else 'www' end, '.brand', cast(l_suppkey % 40 as string), '.example.com/product/', cast(l_partkey as string)) as page_url,
       l_returnflag = 'R' as via_recipe, l_linenumber <> 7 as created_any
from lineitem
"""

# answers to recipe-building requests, one per learned domain
DERIVED["recipe_answers"] = """
select c_custkey as answer_id, concat('shop', cast(c_custkey as string), '.example.com') as domain,
       case c_custkey % 4
         when 0 then concat('{"main_image_selector": "img.', lower(c_mktsegment), '", "gallery_image_selector": null, "notes": "n"}')
         when 1 then '```json {"main_image_selector": null, "gallery_image_selector": "div.g img", "image_url_attribute": "data-src", "excluded_url_patterns": "thumb,logo"} ```'
         when 2 then '{"main_image_selector": null, "gallery_image_selector": "", "notes": "no stable markup"}'
         else 'unable to answer' end as text
from customer
"""

# string parameters per scope, some missing, some unparseable
DERIVED["setting_rows"] = """
select c_custkey as scope_id, 'white_threshold' as name, cast(c_nationkey * 10 as string) as value from customer
union all select c_custkey, 'white_bg_min_percent', c_mktsegment from customer
union all select c_custkey, 'min_confidence', cast(cast(floor(c_acctbal) as int) as string) from customer
union all select c_custkey, 'strict_white_main', case c_nationkey % 5 when 0 then 'Yes' when 1 then '0' when 2 then 'TRUE' when 3 then 'off' end from customer
union all select c_custkey, 'output_format', lower(c_mktsegment) from customer where c_acctbal > 0
union all select c_custkey, 'brand_attribute_name', c_mktsegment from customer where c_nationkey % 3 = 0
union all select c_custkey, 'max_images_per_product', case when c_nationkey % 4 = 0 then 'many' else cast(c_nationkey as string) end from customer
union all select c_custkey, 'overwrite_existing_main', case when c_nationkey % 2 = 0 then 'T' else 'no' end from customer where c_nationkey % 7 <> 0
union all select c_custkey, 'request_delay_seconds', case when c_nationkey % 6 = 0 then '2,5' else concat(cast(c_nationkey as string), '.5') end from customer
"""

# image files of all formats; some break off, some are no images
DERIVED["image_blobs"] = """
select image_id, unhex(case
  when label = 9 then concat('474946383961', w16l, h16l, '8000000000000000')
  when label = 8 then concat('FFD8FFE000104A46494600010100000100010000', case when image_id % 3 = 0 then 'FFE10008FFC000010002' else '' end,
       case when image_id % 5 = 0 then 'FFC4' else concat('FFC400040000FFFFC2001108', h16, w16, '03012200021101031101FFDA0008010100003F00') end)
  when label = 7 then concat('52494646', '16000000', '57454250', '56503858', '0A000000', '10000000', w16l, '00', h16l, '00')
  when label = 6 then concat('52494646', case when image_id % 4 = 0 then 'FF000000' else '12000000' end, '57454250', '5650384C', '05000000', '2F', w16l, '4000')
  when label = 5 then concat('52494646', '16000000', '57454250', '56503820', '0A000000', '300100', '9D012A', w16l, h16l)
  when image_id % 9 = 4 then 'DEADBEEF'
  else concat('89504E470D0A1A0A0000000D49484452', '0000', w16, '0000', h16, '080600000000000000', '0000000249444154', 'ABCD00000000',
       case when image_id % 7 = 0 then '0000' else '0000000049454E44AE426082' end) end) as content
from (select image_id, label, w16, h16, concat(substr(w16, 3, 2), substr(w16, 1, 2)) as w16l, concat(substr(h16, 3, 2), substr(h16, 1, 2)) as h16l
  from (select vec_id as image_id, label, lpad(hex(cast(64 + label * 200 + vec_id % 90 as bigint)), 4, '0') as w16,
               lpad(hex(cast(48 + vec_id % 900 as bigint)), 4, '0') as h16 from embeddings) e) f
"""

DERIVED["raster_cells"] = """
select vec_id as image_id, label, 24 as width, 24 as height, cast(p % 24 as int) as x, cast(floor(p / 24) as int) as y,
       case when p % 24 between 8 and 15 and floor(p / 24) between 8 and 15
            then get(embedding, cast((floor(p / 24) - 8) * 8 + (p % 24 - 8) as int)) end as v
from (select vec_id, label, embedding, explode(sequence(0, 575)) as p from embeddings) e
"""

DERIVED["pixels"] = """
select image_id, width, height, x, y,
       cast(case when v is not null then floor(128 + cast(v as double) * 200) when label % 4 = 1 then 250
            when label % 4 = 2 and (x + y) % 5 <> 0 then 250 when label % 4 = 2 then 200 else 90 end as int) as r,
       cast(case when v is not null then floor(140 + cast(v as double) * 200) when label % 4 = 1 then 250
            when label % 4 = 2 and (x + y) % 5 <> 0 then 250 when label % 4 = 2 then 200 else 110 end as int) as g,
       cast(case when v is not null then floor(150 + cast(v as double) * 200) when label % 4 = 1 then 250
            when label % 4 = 2 and (x + y) % 5 <> 0 then 250 when label % 4 = 2 then 200 else 130 end as int) as b,
       case when v is null and label % 4 = 0 then 0 else 255 end as a
from raster_cells
"""

# short text answers to the studio question, for borderline images
DERIVED["studio_answers"] = """
select vec_id as image_id, case when vec_id % 3 = 0 then ' Studio' when vec_id % 3 = 1 then 'CONTEXT' else 'studio shot' end as answer
from embeddings
"""


def for_duckdb(sql: str) -> str:
    """Respell the three Spark-only constructs used in ``DERIVED``."""
    sql = sql.replace("explode(array(", "unnest(list_value(")
    sql = sql.replace("explode(sequence(", "unnest(generate_series(")
    sql = re.sub(r"get\(embedding, (cast\(.*? as int\))\)", r"embedding[\1 + 1]", sql)
    return sql


def dependencies(sql: str) -> list[str]:
    """Derived relations that ``sql`` needs, in definition order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in DERIVED:
            if name in words and name not in need:
                need.add(name)
                todo.append(DERIVED[name])
    return [name for name in DERIVED if name in need]
