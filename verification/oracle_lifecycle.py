import hashlib

from verification.oracle_raster import states

JSON_SIG = '{"bg_color": "#FFFFFF", "jpeg_quality": 92, "output_format": "jpeg", "padding_percent": 8, "target_canvas_size": 1920, "white_threshold": 245}'
SIG = hashlib.sha256(JSON_SIG.encode()).hexdigest()
STORED = f"case gallery_mode when 'auto' then sha256(main_image_text || '{SIG}') when 'yes' then sha256('stale') end"
PLAN = f"""{states()}, plan as (
  select st.image_id, source_state = 'complex' and white >= 70 and white < 90 as borderline,
    case when source_state = 'complex' and white >= 70 and white < 90 and upper(trim(a.answer)) like 'STUDIO%' then 'white' else source_state end as source_state
  from st left join studio_answers a on a.image_id = st.image_id)"""

ORACLES = {
    "settings_signature": """
with w as (select scope_id, max(case when name = 'white_threshold' then value end) as a, max(case when name = 'output_format' then value end) as e from setting_rows group by scope_id)
select scope_id, sha256(concat('{"bg_color": "#FFFFFF", "jpeg_quality": 92, "output_format": "', coalesce(e, 'jpeg'), '", "padding_percent": 8, "target_canvas_size": 1920, "white_threshold": ',
  cast(coalesce(try_cast(a as int), 245) as string), '}')) as signature from w""",
    "output_signature": f"""
select product_id, sha256(concat(main_image_text, '{SIG}')) as signature from products where main_image_text is not null""",
    "skip_unchanged": f"""
with s as (select product_id, main_image_text, {STORED} as normalization_signature from products where main_image_text is not null)
select product_id, normalization_signature from s where normalization_signature is null or normalization_signature <> sha256(concat(main_image_text, '{SIG}'))""",
    "normalize_plan": f"""with {PLAN}
select image_id, source_state, source_state = 'white' as has_white, borderline,
  case source_state when 'transparent' then 'trim' else 'remove_background_then_trim' end as action from plan""",
    "normalize_apply_state": f"""
with s as (select *, {STORED} as sig from products)
select s.product_id, p_size between 5 and 30 or main_image_normalized as main_image_normalized,
  case when p_size between 5 and 30 then p_retailprice > 950 else main_image_already_white_bg end as main_image_already_white_bg,
  case when p_size between 5 and 30 then sha256(p_name) else sig end as normalization_signature,
  case when p_size between 5 and 30 and enrichment_state = 'not_enriched' then 'enriched' else enrichment_state end as enrichment_state
from s join part on p_partkey = s.product_id""",
    "backup_main": "select product_id, coalesce(original_image_text, main_image_text) as original_image_text from products",
    "apply_main_state": f"""
with s as (select *, {STORED} as sig from products),
m as (select c.product_id, c.has_white_background as white, concat('made of ', c.source_url) as image,
    row_number() over (partition by c.product_id order by c.confidence desc, c.candidate_id) as rn
  from candidates c join products p on p.product_id = c.product_id
  where c.state = 'approved' and c.role = 'main' and c.image_width % 7 <> 0 and not (p.has_main_image and p.main_image_normalized))
select s.product_id, coalesce(m.image, main_image_text) as main_image_text,
  case when m.image is not null then coalesce(original_image_text, main_image_text) else original_image_text end as original_image_text,
  m.image is not null or main_image_normalized as main_image_normalized, coalesce(m.white, main_image_already_white_bg) as main_image_already_white_bg,
  case when m.image is not null then sha256(concat(m.image, '{SIG}')) else sig end as normalization_signature,
  case when m.image is not null then 'enriched' else enrichment_state end as enrichment_state
from s left join m on m.product_id = s.product_id and m.rn = 1 and s.product_id % 11 <> 0""",
    "revert_main": """
select product_id, original_image_text as main_image_text, false as main_image_normalized, false as main_image_already_white_bg
from products where original_image_text is not null""",
    "mark_skipped": """
select product_id, case when product_id in (select product_id from candidates where state = 'rejected' and confidence < 0.6) then 'skipped' else enrichment_state end as enrichment_state from products""",
    "normalize_catalog": f"""with {PLAN}, s as (select product_id, main_image_text, {STORED} as sig from products where has_main_image),
due as (select product_id from s where sig is null or sig <> sha256(concat(main_image_text, '{SIG}'))),
bx as (select image_id, coalesce(min(x) filter (where a <> 0), 0) as l, coalesce(min(y) filter (where a <> 0), 0) as t,
  coalesce(max(x) filter (where a <> 0) + 1, max(width)) as r, coalesce(max(y) filter (where a <> 0) + 1, max(height)) as b from pixels group by image_id),
g as (select bx.*, least(1612e0 / (r - l), 1612e0 / (b - t)) as k from bx),
n as (select *, greatest(1, cast(floor((r - l) * k) as int)) as nw, greatest(1, cast(floor((b - t) * k) as int)) as nh from g)
select d.product_id, p.source_state, p.source_state = 'white' as has_white, case p.source_state when 'transparent' then 'trim' else 'remove_background_then_trim' end as action,
  l as "left", t as top, r as "right", b as bottom, round(k, 6) as scale, nw as new_width, nh as new_height,
  cast(floor((1920 - nw) / 2e0) as int) as offset_x, cast(floor((1920 - nh) / 2e0) as int) as offset_y
from due d join plan p on p.image_id = d.product_id join n on n.image_id = d.product_id""",
}
