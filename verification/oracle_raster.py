def states(threshold: int = 245, least: int = 85) -> str:
    """Border measures by joining each pixel with the list of slices that hold it."""
    return f"""
slices as (
  select 'ring' as part, 0 as x0, 24 as x1, 0 as y0, 1 as y1 union all select 'ring', 0, 24, 23, 24
  union all select 'ring', 0, 1, 0, 24 union all select 'ring', 23, 24, 0, 24
  union all select 'top', 0, 5, 0, 5 union all select 'top', 19, 24, 0, 5
  union all select 'bottom', 0, 5, 19, 24 union all select 'bottom', 19, 24, 19, 24
), cells as (
  select image_id, part, r, g, b, a from pixels p join slices s on p.x >= x0 and p.x < x1 and p.y >= y0 and p.y < y1
), pct as (
  select image_id,
    100e0 * count(case when part = 'ring' and a < 32 then 1 end) / count(case when part = 'ring' then 1 end) as clear,
    100e0 * count(case when part = 'ring' and r >= {threshold} and g >= {threshold} and b >= {threshold} then 1 end) / count(case when part = 'ring' then 1 end) as white,
    100e0 * count(case when part = 'top' and r >= {threshold} and g >= {threshold} and b >= {threshold} then 1 end) / count(case when part = 'top' then 1 end) as top,
    100e0 * count(case when part = 'bottom' and r >= {threshold - 15} and g >= {threshold - 15} and b >= {threshold - 15} then 1 end) / count(case when part = 'bottom' then 1 end) as bottom
  from cells group by image_id
), st as (
  select *, case when clear >= 80 then 'transparent' when white >= {least} and top >= 95 and bottom >= 80 then 'white' else 'complex' end as source_state from pct
)"""


ORACLES = {
    "background_state": f"""with {states()}
select image_id, round(clear, 6) as transparent_percent, round(white, 6) as border_white_percent, round(top, 6) as top_white_percent,
       round(bottom, 6) as bottom_white_percent, source_state, source_state = 'white' as has_white,
       case when source_state = 'transparent' then 0e0 else round(white, 6) end as white_percent from st""",
    "border_transparency": f"""with {states()}
select image_id, round(clear, 6) as transparent_percent, clear >= 80 as is_transparent from st""",
    "border_white_percent": f"""with {states(200)} select image_id, round(white, 6) as border_white_percent from st""",
    "corner_white_percent": f"""with {states(215)}
select image_id, round(top, 6) as top_white_percent, round(bottom, 6) as bottom_white_percent from st""",
    "raster_background": f"""with {states()}
select image_id, source_state, case when source_state = 'transparent' then 0e0 else round(white, 6) end as white_percent from st""",
    "raster_pixels": "select image_id, width, height, x, y, r, g, b, a from pixels",
    "bbox_alpha": """
select i.image_id, b.l as "left", b.t as top, b.r as "right", b.b as bottom from (select distinct image_id from pixels) i left join (
  select image_id, min(x) as l, min(y) as t, max(x) + 1 as r, max(y) + 1 as b from pixels where a <> 0 group by image_id) b on b.image_id = i.image_id""",
    "bbox_nonwhite": """
select i.image_id, b.l as "left", b.t as top, b.r as "right", b.b as bottom from (select distinct image_id from pixels) i left join (
  select image_id, greatest(0, min(x) - 1) as l, greatest(0, min(y) - 1) as t, least(24, max(x) + 2) as r, least(24, max(y) + 2) as b
  from pixels where r < 245 or g < 245 or b < 245 group by image_id) b on b.image_id = i.image_id""",
    "white_to_alpha": """
select image_id, x, y, r, g, b, case when r >= 245 and g >= 245 and b >= 245 then 0 else 255 end as a from pixels""",
    "canvas_geometry": """
with s as (select candidate_id, image_width as width, image_height as height, least(806e0 / image_width, 806e0 / image_height) as k from candidates),
z as (select *, case when k < 1 or (width < 806 and height < 806) then cast(floor(width * k) as int) else width end as nw,
             case when k < 1 or (width < 806 and height < 806) then cast(floor(height * k) as int) else height end as nh from s)
select candidate_id, width, height, cast(806 as int) as inner_size, round(k, 6) as scale, nw as new_width, nh as new_height,
       cast(floor((960 - nw) / 2e0) as int) as offset_x, cast(floor((960 - nh) / 2e0) as int) as offset_y from z""",
    "crop_translate": """
with bx as (select image_id, min(x) as l, min(y) as t, max(x) + 1 as r, max(y) + 1 as b from pixels where a <> 0 group by image_id)
select p.image_id, cast(p.x - l + floor((48 - (bx.r - l)) / 2e0) as int) as x, cast(p.y - t + floor((48 - (bx.b - t)) / 2e0) as int) as y,
       p.r, p.g, p.b, case p.a when 255 then 255 else 0 end as a
from pixels p join bx on bx.image_id = p.image_id where p.x >= l and p.x < bx.r and p.y >= t and p.y < bx.b""",
    "flatten_on_color": """
with h as (select image_id, x, y, r, g, b, cast(floor((a + r) / 2e0) as int) as a from pixels)
select image_id, x, y,
  cast(round((r * a + case when y < 12 then 0 else 51 end * (255 - a)) / 255e0) as int) as r,
  cast(round((g * a + case when y < 12 then 170 else 102 end * (255 - a)) / 255e0) as int) as g,
  cast(round((b * a + case when y < 12 then 255 else 153 end * (255 - a)) / 255e0) as int) as b from h""",
    "checkerboard_composite": """
with s as (select *, case when (x // 16 + y // 16) % 2 = 0 then 208 else 240 end as shade from pixels)
select image_id, x, y, case a when 255 then r else shade end as r, case a when 255 then g else shade end as g,
       case a when 255 then b else shade end as b from s""",
    "output_format_choice": """
select candidate_id, case when role = 'main' then 'PNG' when job_id % 5 = 1 then 'PNG'
  when job_id % 5 = 2 and not has_white_background and image_width > 900 then 'PNG' else 'JPEG' end as file_format from candidates""",
    "preview_report": f"""with {states(240, 70)}
select image_id, source_state = 'white' as detected_white_bg,
  case when source_state = 'transparent' then 0e0 else round(white, 6) end as detected_white_pct,
  case when source_state = 'transparent' then 0e0 else round(top, 6) end as detected_top_corner_pct,
  case when source_state = 'transparent' then 0e0 else round(bottom, 6) end as detected_bottom_corner_pct,
  case when source_state = 'white' then 'clean studio source' else 'complex background' end as notes from st""",
    "regenerate_background": f"""with {states()}
select c.candidate_id, case when st.image_id is null then c.has_white_background else source_state = 'white' end as has_white_background,
  case when st.image_id is null then null when source_state = 'transparent' then 0e0 else round(white, 6) end as background_white_percent
from candidates c left join st on st.image_id = c.product_id""",
}
