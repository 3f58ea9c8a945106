from verification.oracle_discovery import ALNUM, DISCOVERED, HOST, NAMED
from verification.oracle_raster import states

BASE = """regexp_extract(url, '^([a-z]+)://', 1) as sch, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as pth, regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) as qry"""
FOLDER = "regexp_replace(pth, '[^/]*$', '')"
PARENT = f"regexp_replace({FOLDER}, '[^/]+/$', '')"


def attr(name: str) -> str:
    return f"""regexp_extract(tag, ' {name}=["'']([^"'']*)["'']', 1)"""


TAG = """'<(?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""

INV = f"""tags as (
  select page_id, url as page_url, {BASE}, unnest(range(len(ts))) as pos, unnest(ts) as tag
  from (select page_id, url, list_filter(regexp_extract_all(html, {TAG}), lambda x: x like '<img %') as ts from crawl_pages)
), srcs as (
  select *, replace(case when {attr('src')} <> '' then {attr('src')} when {attr('data-src')} <> '' then {attr('data-src')} else {attr('data-lazy-src')} end, '&amp;', '&') as src from tags
), inv as (
  select page_id, page_url, cast(pos as int) as pos,
    case when src like 'https:%' then src when src like '//%' then concat(sch, ':', src) when src like '/%' then concat(origin, src)
      when src like '?%' then concat(origin, pth, src) when src like '../%' then concat(origin, {PARENT}, 'up/', replace(src, '../up/./', ''))
      else concat(origin, {FOLDER}, src) end as url,
    trim({attr('alt')}) as alt,
    coalesce(try_cast(nullif(regexp_extract(tag, ' width="?(\\w+)', 1), '') as int), 0) as width,
    coalesce(try_cast(nullif(regexp_extract(tag, ' height="?(\\w+)', 1), '') as int), 0) as height
  from srcs where src <> ''
), ded as (
  select * exclude (rn) from (select *, row_number() over (partition by page_id, url order by pos) as rn from inv) where rn = 1
), good as (
  select * from ded where not regexp_matches(lower(url), 'sprite|icon|logo|flag-|placeholder|spinner|social|twitter|facebook|instagram|/avatar')
    and not (width <> 0 and height <> 0 and width < 200 and height < 200 and alt = '') and not lower(url) like '%.svg'
)"""
CONTEXT = """body as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g') as h from crawl_pages
), ctx as (
  select page_id, left(array_to_string(list_filter(list_transform(regexp_split_to_array(substr(h, strpos(h, '<body>') + 6), '<(?:[^>"'']|"[^"]*"|''[^'']*'')*>'),
     lambda s: trim(replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), e' \\n\\r\\t')), lambda s: s <> ''), ' '), 300) as context from body
)"""
RAW = """raw as (select *, nullif(regexp_extract(text, '(?s)\\{.*\\}'), '') as o from llm_responses),
ans as (select response_id, product_id, page_pos, page_url, o, coalesce(json_extract_string(o, '$.page_is_correct_product') = 'true', false) as ok,
  coalesce(cast(json_extract_string(o, '$.product_match_confidence') as double), 0e0) as mc from raw)"""
CHOSEN = f"""{RAW}, opts as (
  select product_id, page_pos, page_url, mc as match_confidence, false as via_recipe, o from ans where ok and mc >= 0.5e0
  union all select product_id, page_pos, page_url, 0.9e0, true, null from recipe_hits
), chosen as (
  select * from (select *, row_number() over (partition by product_id order by page_pos, case when via_recipe then 0 else 1 end) as rn from opts) where rn = 1
)"""
IMGS = f"""{CHOSEN}, imgs as (
  select product_id, page_url, i as pos, json_extract_string(o, concat('$.images[', cast(i as string), '].url')) as url,
    coalesce(json_extract_string(o, concat('$.images[', cast(i as string), '].role')), 'uncertain') as role,
    cast(json_extract_string(o, concat('$.images[', cast(i as string), '].confidence')) as double) as confidence
  from (select *, unnest(range(cast(json_array_length(o, '$.images') as bigint))) as i from chosen where not via_recipe)
  union all select c.product_id, c.page_url, 0, h.main_url, 'main', 0.9e0 from chosen c join recipe_hits h on h.product_id = c.product_id where via_recipe
  union all select c.product_id, c.page_url, 1, h.gallery_url, 'angle', 0.85e0 from chosen c join recipe_hits h on h.product_id = c.product_id where via_recipe and h.gallery_url is not null
), {NAMED}, flags as (
  select m.product_id, m.maker, p.gallery_mode = 'yes' or (p.gallery_mode = 'auto' and coalesce(c.enable_gallery, false)) as gal
  from makers m join products p on p.product_id = m.product_id left join categories c on c.category_id = p.category_id
), gated as (
  select i.product_id, i.page_url, cast(i.pos as int) as pos, i.url, i.role, i.confidence, f.maker, f.gal
  from imgs i join flags f on f.product_id = i.product_id where i.confidence >= 0.7e0 and i.url is not null and (i.role = 'main' or f.gal)
)"""
K = ALNUM.format("maker")
ON = f"({K} <> '' and contains({ALNUM.format(HOST.replace('url', '{u}'))}, {K}))".replace("[^/?#]", "[^/?#]")
ON_PAGE = ON.replace("{u}", "page_url")
ON_IMG = ON.replace("{u}", "url")
BRANDED = f"{IMGS}, branded as (select *, {ON_PAGE} as on_brand_page, not {ON_PAGE} or {ON_IMG} as accepted from gated)"
VALID = f"""{BRANDED}, checked as (
  select b.*, a.n_bytes, a.width, a.height, a.has_white, a.studio_answer, case lower(a.content_type) when '' then 'image/jpeg' else lower(a.content_type) end as mime,
    case when a.n_bytes < 4096 then 'too small' when not a.decodable then 'invalid image' when a.width < 600 then concat('width ', cast(a.width as string), ' < min 600') end as problem
  from branded b join asset_facts a on a.url = b.url where b.accepted and a.status = 200 and a.n_bytes <= 10485760
)"""
DOWN = f"""{VALID}, down as (
  select * exclude (role, has_white), case when role = 'main' and not has_white and not coalesce(upper(trim(studio_answer)) like 'STUDIO%', false) then 'in_use' else role end as role,
    has_white or (role = 'main' and coalesce(upper(trim(studio_answer)) like 'STUDIO%', false)) as has_white from checked where problem is null
), kept_all as (
  select *, row_number() over (partition by product_id order by pos) as place from down where role = 'main' or gal
), kept as (select * from kept_all where place <= 4)"""
RUNS = """runs as (select distinct product_id from job_products join jobs on jobs.job_id = job_products.job_id where state = 'running' and pending and pipeline_steps in ('discover_apply', 'full')),
due as (select c.*, p.has_main_image and p.main_image_normalized as locked from candidates c join products p on p.product_id = c.product_id
  where c.state = 'pending' and c.confidence >= 0.85e0 and c.product_id in (select product_id from runs)),
ordered as (select *, image_width % 7 = 0 as lost, row_number() over (partition by product_id, role = 'main', image_width % 7 = 0 order by confidence desc, candidate_id) as rn from due),
applied as (select candidate_id, product_id, role, lost, case when lost or role = 'main' and (locked or rn > 1) then 'failed' else 'applied' end as state from ordered)"""
# every page judged by itself; a product has looked at those up to its first settled one
JUDGED = f"""{DISCOVERED}, visited as (
  select d.*, regexp_extract(page_url, '^https://([^/]*)', 1) as h, regexp_extract(page_url, '^https://[^/]*(.*)$', 1) as path from discovered d
), parsed as (select product_id, page_url, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') as o from page_answers),
facts as (
  select v.*, h in (select host from site_ips where ip not like '10.%') as safe, not exists (select 1 from site_rules r where r.host = h and starts_with(v.path, r.path)) as free,
    f.status = 200 and f.content_type like '%html%' as usable, len(regexp_extract_all(f.html, '<img[^>]*>')) as n_img, f.html,
    r.main_image_selector = 'img.hero' as readable, p.page_url is not null as answered, p.o
  from visited v left join page_fetches f on f.url = v.page_url left join (select * from page_recipes where recipe_built and active) r on r.domain = h
  left join parsed p on p.product_id = v.product_id and p.page_url = v.page_url
), verdicts as (
  select *, coalesce(cast(json_extract_string(o, '$.product_match_confidence') as double), 0e0) as mc,
    case when not safe then 'refused' when not free then 'robots' when not coalesce(usable, false) then 'unusable' when readable then 'recipe'
      when not answered then 'unanswered' when o is null then 'unreadable'
      when json_extract_string(o, '$.page_is_correct_product') = 'true' and coalesce(cast(json_extract_string(o, '$.product_match_confidence') as double), 0e0) >= 0.5e0 then 'accepted'
      else 'rejected' end as outcome from facts
), looked as (
  select * from verdicts v where not exists (select 1 from verdicts e where e.product_id = v.product_id and e.page_pos < v.page_pos and e.outcome in ('recipe', 'accepted'))
), rated as (
  select *, outcome in ('unanswered', 'unreadable', 'rejected', 'accepted') and n_img < 5 as rendered,
    outcome not in ('refused', 'robots', 'unusable') and coalesce(not readable, false) as recipe_failed from looked
), round_hits as (
  select product_id, regexp_extract(html, 'class="hero" src="([^"]*)"', 1) as main_url, regexp_extract(html, '<img src="([^"]*_g.jpg)"', 1) as gallery_url from rated where outcome = 'recipe'
), chosen as (
  select product_id, page_pos, page_url, case when outcome = 'recipe' then 0.9e0 else mc end as match_confidence, outcome = 'recipe' as via_recipe, o from rated where outcome in ('recipe', 'accepted')
)"""
_IMGS = IMGS.replace(CHOSEN, JUDGED).replace("recipe_hits", "round_hits").replace(f", {NAMED}, flags", ", flags")
ROUNDS = DOWN.replace(IMGS, _IMGS)

ORACLES = {
    "img_inventory": f"with {INV} select page_id, page_url, pos, url, alt, width, height from inv",
    "url_resolve": f"""
with r as (select page_id, url, {BASE}, unnest(['https://cdn.example.com/a/../b.png', '//cdn.example.com/x', '/img/./a/../b.jpg',
  '../up/../../c.png?q=../x#f', 'd//e;p=1/f.jpg;v=2', '?only=query', '#frag', '', '..', 'data:image/png;base64,AA', '/']) as ref from pages)
select page_id, ref, case ref when '//cdn.example.com/x' then concat(sch, ':', ref) when '/img/./a/../b.jpg' then concat(origin, '/img/b.jpg')
  when '../up/../../c.png?q=../x#f' then concat(origin, '/c.png?q=../x#f') when 'd//e;p=1/f.jpg;v=2' then concat(origin, {FOLDER}, 'd/e;p=1/f.jpg;v=2')
  when '?only=query' then concat(origin, pth, ref) when '#frag' then concat(origin, pth, qry, ref) when '' then url
  when '..' then concat(origin, {PARENT}) when '/' then concat(origin, '/') else ref end as resolved from r""",
    "img_dedupe": f"with {INV} select page_id, page_url, pos, url, alt, width, height from ded",
    "img_junk_filter": f"with {INV} select page_id, page_url, pos, url, alt, width, height from good",
    "img_cap": f"""
with {INV}, narrow as (select page_id, pos, url from good), n as (select page_id, (select count(*) from tags t where t.page_id = p.page_id) as base, url from pages p),
wide as (select page_id, cast(base + k as int) as pos, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/wide/', cast(k + 1 as string), '.jpg') as url
  from (select *, unnest(range(page_id % 90 + 1)) as k from n)),
every as (select * from narrow union all select * from wide)
select page_id, pos, url from (select *, row_number() over (partition by page_id order by pos) as rn from every) where rn <= 60""",
    "img_context": f"with {INV}, {CONTEXT} select g.page_id, g.pos, g.url, c.context from good g join ctx c on c.page_id = g.page_id",
    "render_flag": """
select page_id, cast(n as int) as n_img, n < 5 as needs_render
from (select page_id, len(list_filter(regexp_extract_all(html, '<(?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda x: x like '<img %')) as n from crawl_pages)""",
    "prompt_rows": f"""
with {INV}, {CONTEXT}, {NAMED}, lines as (
  select g.page_id, any_value(g.page_url) as page_url, count(*) as n, string_agg(concat('- url=', url, ' | alt="', left(alt, 100), '" | w=', cast(width as string), ' h=', cast(height as string), ' | context="', left(c.context, 160), '"'), chr(10) order by pos) as body
  from good g join ctx c on c.page_id = g.page_id group by g.page_id)
select m.product_id, f.url as page_url, cast(coalesce(l.n, 0) as int) as n_images, case when l.n > 0 then concat('PRODUCT CONTEXT:', chr(10), 'name: ', p.name, chr(10), 'sku: ', case when coalesce(p.manufacturer_sku, '') <> '' then p.manufacturer_sku else p.default_code end, chr(10),
  'manufacturer: ', m.maker, case when c.name is null then '' else concat(chr(10), 'category: ', c.name) end, chr(10), chr(10), 'PAGE URL: ', l.page_url, chr(10), chr(10), 'IMAGES (', cast(l.n as string), ' candidates):', chr(10), l.body) end as request_text,
  case when l.n is null then '{{"page_is_correct_product": false, "product_match_confidence": 0.0, "match_reasoning": "page has no images", "images": [], "rejected": []}}' end as answer
from makers m join products p on p.product_id = m.product_id join crawl_pages f on f.page_id = m.product_id left join lines l on l.page_id = m.product_id left join categories c on c.category_id = p.category_id""",
    "classification_gate": f"with {RAW} select response_id, product_id, page_pos from ans where ok and mc >= 0.5e0",
    "choose_page": f"""with {CHOSEN}
select c.product_id, c.page_pos, c.page_url, match_confidence, via_recipe,
  cast(case when via_recipe then case when h.gallery_url is null then 1 else 2 end else json_array_length(o, '$.images') end as int) as n_images
from chosen c left join recipe_hits h on h.product_id = c.product_id""",
    "has_main_candidate": f"""with {RAW}, im as (
  select response_id, json_extract_string(o, concat('$.images[', cast(i as string), '].role')) as role, cast(json_extract_string(o, concat('$.images[', cast(i as string), '].confidence')) as double) as conf
  from (select response_id, o, unnest(range(cast(json_array_length(o, '$.images') as bigint))) as i from ans where o is not null))
select response_id, response_id in (select response_id from im where role = 'main' and conf >= 0.7e0) as has_main_candidate from ans""",
    "candidate_gates": f"with {IMGS} select product_id, pos, url, role, confidence from gated",
    "brand_host_filter": f"with {BRANDED} select product_id, pos, url, on_brand_page, accepted from branded",
    "brand_fallback_notes": f"""with {CHOSEN}, {NAMED}
select c.product_id, 'classify' as step, 'info' as level, concat('No brand page for ', maker, ', using ', page_url) as message
from chosen c join makers m on m.product_id = c.product_id where maker <> '' and not {ON_PAGE}""",
    "image_validity": f"with {VALID} select product_id, pos, url, n_bytes, problem from checked",
    "main_downgrade": f"with {DOWN} select product_id, pos, url, role, has_white from kept_all",
    "candidate_topn": f"with {DOWN} select product_id, pos, cast(place as int) as place, url, role, confidence from kept",
    "candidate_rejections": f"""with {DOWN}, rej as (
  select product_id, pos, url, 'classify' as step, 'off-brand image host on brand page' as message from branded where not accepted
  union all select product_id, pos, url, 'download_image', problem from checked where problem is not null)
select r.* from rej r where not exists (select 1 from kept k where k.product_id = r.product_id and k.place = 4 and k.pos < r.pos)""",
    "candidate_metadata": f"""with {DOWN}
select product_id, pos, width as image_width, height as image_height, cast(n_bytes // 1024 as int) as image_filesize_kb, mime as image_mimetype from kept""",
    "candidate_stats": f"""with {DOWN}, shots as (
  select a.product_id, count(*) as n from ans a left join chosen c on c.product_id = a.product_id
  where a.page_pos % 2 = 0 and (c.product_id is null or a.page_pos < c.page_pos or (a.page_pos = c.page_pos and not c.via_recipe)) group by a.product_id)
select p.product_id, (select count(*) from kept k where k.product_id = p.product_id and k.has_white) as white_bg,
  (select count(*) from kept k where k.product_id = p.product_id and not k.has_white) as rembg,
  cast(coalesce(c.via_recipe, false) as int) as recipe_hit, cast(coalesce(not c.via_recipe, false) as int) as recipe_miss, coalesce(s.n, 0) as screenshot_used
from products p left join chosen c on c.product_id = p.product_id left join shots s on s.product_id = p.product_id""",
    "product_state_after_discovery": f"""with {DOWN}
select p.product_id, case when p.product_id not in (select product_id from kept) then 'no_results'
  when p.product_id in (select product_id from kept where role = 'main') then 'candidates_found' else 'needs_manual_main' end as enrichment_state from products p""",
    "auto_apply": f"""with {RUNS}
select * exclude (lost), case when lost then 'Candidate has no image data' when state = 'failed' then 'Main image already normalized — enable overwrite_existing_main to replace' end as rejection_reason from applied""",
    "auto_apply_products": f"with {RUNS} select distinct product_id from applied where state = 'applied' and role = 'main'",
    "studio_borderline": f"""with {states()}
select st.image_id, round(white, 6) as white_percent, case when upper(trim(a.answer)) like 'STUDIO%' then 'white' else 'complex' end as final_state
from st left join studio_answers a on a.image_id = st.image_id where source_state = 'complex' and white >= 70 and white < 90""",
    "discovery_rounds": f"""with recursive {JUDGED}
select product_id, page_pos, page_url, outcome, rendered, recipe_failed,
  cast(case outcome when 'recipe' then 2 when 'accepted' then json_array_length(o, '$.images') else 0 end as int) as n_images from rated""",
    "discovery_outcome": f"""with recursive {ROUNDS}
select p.product_id, case when p.product_id not in (select product_id from kept) then 'no_results'
    when p.product_id in (select product_id from kept where role = 'main') then 'candidates_found' else 'needs_manual_main' end as enrichment_state,
  (select count(*) from kept k where k.product_id = p.product_id and k.has_white) as white_bg,
  (select count(*) from kept k where k.product_id = p.product_id and not k.has_white) as rembg,
  cast(coalesce(c.via_recipe, false) as int) as recipe_hit, cast(coalesce(not c.via_recipe, false) as int) as recipe_miss,
  (select count(*) from rated r where r.product_id = p.product_id and rendered) as screenshot_used, c.page_url
from products p left join chosen c on c.product_id = p.product_id""",
    "discovery_log": f"""with recursive {ROUNDS}, rej as (
  select product_id, pos, url, 'classify' as step, 'off-brand image host on brand page' as message from branded where not accepted
  union all select product_id, pos, url, 'download_image', problem from checked where problem is not null)
select product_id, 'classify' as step, 'error' as level, concat('Unusable answer for ', page_url) as message from rated where outcome = 'unreadable'
union all select product_id, 'classify', 'warning', concat('Unreadable recipe for ', h) from rated where recipe_failed
union all select c.product_id, 'classify', 'info', concat('No brand page for ', maker, ', using ', page_url) from chosen c join makers m on m.product_id = c.product_id where maker <> '' and not {ON_PAGE}
union all select r.product_id, step, 'warning', concat(url, ': ', message) from rej r where not exists (select 1 from kept k where k.product_id = r.product_id and k.place = 4 and k.pos < r.pos)""",
}
