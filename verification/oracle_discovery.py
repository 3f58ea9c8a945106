NAMED = """makers as (
  select p.product_id, p.name,
    case when p.manufacturer_override is not null and p.manufacturer_override <> '' then trim(p.manufacturer_override)
         when b.v is not null then trim(b.v) else split_part(trim(p.name), ' ', 1) end as maker,
    trim(case when coalesce(p.manufacturer_sku, '') <> '' then p.manufacturer_sku else coalesce(p.default_code, '') end) as sku
  from products p left join (
    select product_id, arg_min(value_name, line_no * 1000 + value_no) as v from attribute_lines
    where lower(trim(attribute_name)) = 'brand' and value_name is not null group by product_id) b on b.product_id = p.product_id)"""
HOST = "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)', 1)"
KEEP = f"""url is not null and url <> ''
  and not regexp_matches(lower({HOST}), 'amazon\\.|ebay\\.|walmart\\.|aliexpress\\.|wish\\.|pinterest\\.|reddit\\.|facebook\\.|youtube\\.com|tiktok\\.|instagram\\.')
  and not regexp_matches(lower({PATH}), '\\.(pdf|doc|xls|ppt)$')"""
ALNUM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
RANKED = f"""ranked as (
  select s.product_id, s.rank, s.url, case when m.maker <> '' and contains({ALNUM.format('regexp_extract(s.url, $$^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)$$, 1)')}, {ALNUM.format('m.maker')}) then 0 else 1 end as host_rank
  from search_results s join makers m on m.product_id = s.product_id where {KEEP.replace('url', 's.url')})"""
GUESSES = """guesses as (
  select product_id, sku, 0 as guess_no, concat(replace(lower(maker), ' ', ''), '.com') as host from makers where maker <> ''
  union all select product_id, sku, 1, concat(replace(lower(maker), ' ', '-'), '.com') from makers where maker <> '')"""
ADDRESSES = """addresses as (
  select host, k.p as preference, concat(k.a, regexp_replace(host, '^[w.]+', ''), k.z) as sitemap_url
  from (select distinct host from guesses) g, (select 0 as p, 'https://' as a, '/sitemap.xml' as z union all select 1, 'https://', '/sitemap_index.xml'
    union all select 2, 'https://www.', '/sitemap.xml' union all select 3, 'https://', '/sitemap-index.xml') k)"""
# depth-first walk with all paths, first visit per sitemap, 101 sitemaps per root, 50,000 urls before a sitemap starts
EXPAND = """walk as (
  select sitemap_url as root, sitemap_url as node, '' as doc_path, 0 as depth from roots
  union all
  select w.root, s.loc, concat(w.doc_path, lpad(cast(s.pos as string), 8, '0'), ' ', s.loc, '/'), w.depth + 1
  from walk w join sitemap_store s on s.sitemap_url = w.node and s.kind = 'index' where w.depth < 5
), firsts as (
  select root, node, min(doc_path) as doc_path from walk group by root, node
), seen as (
  select *, row_number() over (partition by root order by doc_path) as visit from firsts
), sized as (
  select s.root, s.node, s.doc_path, coalesce(n, 0) as n
  from seen s left join (select sitemap_url, count(*) as n from sitemap_store where kind = 'urlset' group by sitemap_url) c on c.sitemap_url = s.node where visit <= 101
), under as (
  select a.root, a.doc_path as above, left(z.doc_path, length(a.doc_path) + strpos(substr(z.doc_path, length(a.doc_path) + 10), '.xml/') + 13) as child, sum(z.n) as n
  from sized a join sized z on z.root = a.root and starts_with(z.doc_path, a.doc_path) and z.doc_path <> a.doc_path group by all
), late as (
  select root, child from (select *, sum(n) over (partition by root, above order by child rows between unbounded preceding and 1 preceding) as earlier from under) where earlier >= 50000
), expanded as (
  select root, u.sitemap_url, doc_path, pos, loc from sized z join sitemap_store u on u.sitemap_url = z.node and u.kind = 'urlset'
  where not exists (select 1 from late l where l.root = z.root and starts_with(z.doc_path, l.child))
)"""
ERASE = "regexp_replace(lower({}), '[\\s_-]', '', 'g')"
HOSTNAME = """case when h like '[%' then regexp_extract(h, '^\\[([^\\]]*)\\]', 1) else split_part(h, ':', 1) end"""
V4NUM = """cast(split_part({0}, '.', 1) as bigint) * 16777216 + cast(split_part({0}, '.', 2) as bigint) * 65536 + cast(split_part({0}, '.', 3) as bigint) * 256 + cast(split_part({0}, '.', 4) as bigint)"""
PRIVATE = """private_blocks(lo, hi) as (values (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183),
  (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487),
  (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4294967295))"""

DISCOVERED = f"""{NAMED}, {GUESSES}, {ADDRESSES}, roots as (select distinct sitemap_url from addresses), {EXPAND},
site as (select host, arg_min(sitemap_url, preference) as root from addresses where sitemap_url in (select root from expanded) group by host),
urls as (select s.host, e.doc_path, e.pos, e.loc from site s join expanded e on e.root = s.root),
raw as (select g.product_id, g.guess_no, u.loc, u.doc_path, u.pos from guesses g join urls u on u.host = g.host
  and (contains(lower(u.loc), lower(g.sku)) or contains({ERASE.format('u.loc')}, {ERASE.format('g.sku')})) where g.sku <> ''),
hit as (select product_id, loc, row_number() over (partition by product_id order by doc_path, pos) as place from raw r
  where guess_no = (select min(guess_no) from raw q where q.product_id = r.product_id)),
nhit as (select m.product_id, count(h.loc) as n from makers m left join hit h on h.product_id = m.product_id and h.place <= 10 group by m.product_id),
{RANKED},
fresh as (select r.product_id, r.url, min(r.host_rank * 100000 + r.rank) as k, any_value(n.n) as n from ranked r join nhit n on n.product_id = r.product_id
  where n.n < 3 and not exists (select 1 from hit h where h.product_id = r.product_id and h.place <= 10 and h.loc = r.url) group by r.product_id, r.url),
placed as (select product_id, url, n + row_number() over (partition by product_id order by k, url) as place from fresh),
discovered as (select product_id, cast(place - 1 as int) as page_pos, loc as page_url, 'sitemap' as found_by from hit where place <= 5
union all select product_id, cast(place - 1 as int), url, 'search' from placed where place <= 5)"""

ORACLES = {
    "url_netloc": f"""
with n as (select request_id, url, {HOST} as netloc from request_urls), k as (select *, regexp_replace(lower(netloc), '^.*@', '') as h from n)
select request_id, netloc, {HOSTNAME} as hostname, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as scheme, {PATH} as path from k""",
    "norm_alnum": f"""
select doc_id, md5({ALNUM.format('text')}) as norm_md5, cast(length({ALNUM.format('text')}) as int) as norm_length from documents""",
    "host_contains_brand": f"""
select product_id, rank, url, contains({ALNUM.format(HOST)}, {ALNUM.format('p_brand')}) as on_brand
from search_results join part on p_partkey = product_id where url is not null""",
    "search_query_text": f"""with {NAMED}
select product_id, left(concat_ws(' ', nullif(maker, ''), nullif(sku, ''), nullif(trim(name), '')), 200) as query_text from makers""",
    "search_result_filter": f"select product_id, rank, url from search_results where {KEEP}",
    "search_result_rank": f"""with {NAMED}, {RANKED} select product_id, cast(host_rank as int) as host_rank, rank, url from ranked order by product_id, host_rank, rank, url""",
    "manufacturer_host_guesses": f"""with {NAMED}, {GUESSES} select product_id, cast(guess_no as int) as guess_no, host from guesses""",
    "sitemap_host_normalize": f"""
select page_id, ltrim(lower({HOST}), 'w.') as host, regexp_replace(lower({HOST}), '^www\\.', '') as strict_host, ltrim(lower({HOST}), 'w.') as bare_host from pages""",
    "sitemap_candidates": f"""with recursive {NAMED}, {GUESSES}, {ADDRESSES}, roots as (select distinct sitemap_url from addresses), {EXPAND}
select host, arg_min(sitemap_url, preference) as sitemap_url, cast(min(preference) as int) as preference from addresses
where sitemap_url in (select root from expanded) group by host""",
    "sitemap_expand": f"""with recursive roots as (select distinct root as sitemap_url from sitemap_layout), {EXPAND}
select root, sitemap_url, pos, loc from expanded""",
    "sku_url_match": f"""with recursive roots as (select distinct root as sitemap_url from sitemap_layout), {EXPAND},
urls as (select split_part(root, '/', 3) as host, doc_path, pos, loc from expanded),
wanted as (select distinct host, case when p_partkey % 50 = 0 then '- _' else concat('Sku ', cast(p_partkey as string)) end as sku from sitemap_layout),
hits as (select w.host, w.sku, u.loc, row_number() over (partition by w.host, w.sku order by doc_path, pos) as place
  from wanted w join urls u on u.host = w.host and (contains(lower(u.loc), lower(trim(w.sku))) or contains({ERASE.format('u.loc')}, {ERASE.format('w.sku')})))
select host, sku, cast(place as int) as place, loc from hits where place <= 10""",
    "discover_pages": f"with recursive {DISCOVERED} select * from discovered",
    "ssrf_filter_literal": f"""
with {PRIVATE}, n as (select request_id, url, regexp_replace(lower({HOST}), '^.*@', '') as h from request_urls), k as (select request_id, url, {HOSTNAME} as hn from n),
v4 as (select hn, {V4NUM.format('hn')} as num from (select distinct hn from k where regexp_full_match(hn, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}')) d)
select request_id, url from k where regexp_matches(lower(url), '^https?://') and hn <> ''
  and hn not in ('localhost', 'localhost.localdomain', 'metadata.google.internal', 'metadata', 'instance-data', '::1')
  and hn not in (select hn from v4 join private_blocks on num between lo and hi)""",
    "ssrf_filter_resolved": f"""
with {PRIVATE}, v4 as (select ip, {V4NUM.format('ip')} as num from (select distinct ip from resolved_ips where ip not like '%:%') d),
bad as (select ip from v4 join private_blocks on num between lo and hi union select ip from resolved_ips where starts_with(ip, 'fe80:'))
select page_id, url from pages where {HOST} in (select host from resolved_ips)
  and {HOST} not in (select host from resolved_ips where ip in (select ip from bad))""",
    "robots_gate": f"""
with p as (select page_id, url, {HOST} as host, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) as path from pages),
chosen as (select *, bool_or(agent = 'ImageBot') over (partition by host) as named from robots_rules where agent in ('ImageBot', '*')),
rule as (select host, ord, allow, path from chosen where (named and agent = 'ImageBot') or (not named and agent = '*'))
select p.page_id, p.url, coalesce(arg_min(r.allow, r.ord), true) as allowed
from p left join rule r on r.host = p.host and starts_with(p.path, r.path) group by p.page_id, p.url""",
    "politeness_schedule": """
with n as (select request_id, host, arrival_s, row_number() over (partition by host order by arrival_s, request_id) - 1 as seq from fetch_requests)
select request_id, host, arrival_s, seq, round(2 * seq + max(arrival_s - 2 * seq) over (partition by host order by seq rows unbounded preceding), 4) as start_s from n""",
    "page_gate": """
select page_id, url from crawl_pages where status = 200 and html <> '' and contains(lower(content_type), 'html')
  and not contains(lower(html), 'checking your browser') and not contains(lower(html), '__cf_bm')""",
    "page_strip_noise": """
with s as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g') as h from pages)
select page_id, cast(length(h) as int) as html_length, md5(h) as html_md5 from s""",
    "download_gate": """
select candidate_id, url, n_bytes, case lower(content_type) when '' then 'image/jpeg' else lower(content_type) end as mimetype
from downloads where status = 200 and n_bytes <= 10485760 and (lower(content_type) like 'image/%' or regexp_matches(lower(url), '\\.(jpe?g|png|webp)$'))""",
}
