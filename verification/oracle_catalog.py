ROLE_RANK = """case role when 'main' then 0 when 'angle' then 1 when 'detail' then 2 when 'in_use' then 3
 when 'lifestyle' then 4 when 'accessory' then 5 else 9 end"""
IDS = "product_id, name, default_code, category_id"
CONTEXT = """(select l_partkey from lineitem where l_returnflag = 'R' and l_quantity >= 49)"""
CHOSEN = "(select p_partkey from part where p_size = 7)"
SUBTREE = """(select category_id from categories where name in ('ASIA', 'EUROPE', 'NATION_1')
  or parent_id in (select category_id from categories where name in ('ASIA', 'EUROPE')))"""

ORACLES = {
    "effective_manufacturer": """
select p.product_id,
       case when p.manufacturer_override is not null and p.manufacturer_override <> '' then trim(p.manufacturer_override)
            when b.value_name is not null then trim(b.value_name)
            else split_part(trim(coalesce(p.name, '')), ' ', 1) end as effective_manufacturer
from products p left join (
  select product_id, value_name, row_number() over (partition by product_id order by line_no, value_no) as rn
  from attribute_lines where lower(trim(attribute_name)) = 'brand' and value_name is not null
) b on b.product_id = p.product_id and b.rn = 1""",
    "effective_sku": """
select product_id, trim(case when coalesce(manufacturer_sku, '') <> '' then manufacturer_sku else coalesce(default_code, '') end) as effective_sku
from products""",
    "gallery_enabled": """
select p.product_id, case p.gallery_mode when 'yes' then true when 'no' then false else coalesce(c.enable_gallery, false) end as gallery_enabled
from products p left join categories c on c.category_id = p.category_id""",
    "candidate_counts": """
select p.product_id, count(c.candidate_id) as candidate_count,
       count(case when c.state = 'pending' then 1 end) as pending_candidate_count
from products p left join candidates c on c.product_id = p.product_id group by p.product_id""",
    "image_count": """
select p.product_id, p.has_main_image,
       (select count(*) from gallery_images g where g.product_id = p.product_id) + case when p.has_main_image then 1 else 0 end as image_count
from products p""",
    "role_priority": f"select candidate_id, role, cast({ROLE_RANK} as int) as role_priority from candidates",
    "role_sequence": """
select candidate_id, role, cast(case role when 'main' then 0 when 'angle' then 10 when 'detail' then 20 when 'in_use' then 30
 when 'lifestyle' then 40 when 'accessory' then 50 else 99 end as int) as role_sequence from candidates""",
    "candidate_order": f"""
select candidate_id, product_id, role, confidence, cast({ROLE_RANK} as int) as role_priority
from candidates order by product_id, role_priority, confidence desc, candidate_id""",
    "candidate_board": """
select product_id, count(*) as n_candidates, count(*) filter (where state = 'pending') as n_pending,
       count(*) filter (where state = 'approved') as n_approved, count(*) filter (where state = 'applied') as n_applied,
       count(*) filter (where state = 'rejected') as n_rejected, count(*) filter (where state = 'failed') as n_failed,
       count(*) filter (where role = 'main') as n_main, max(confidence) as best_confidence
from candidates group by product_id""",
    "select_explicit": f"""
select {IDS} from products where product_id in {CONTEXT} or product_id in {CHOSEN}""",
    "select_missing_images": f"select {IDS} from products where not has_main_image and is_published",
    "select_single_image": f"""
select {IDS}, 1 + n as image_count from (
  select p.*, (select count(*) from gallery_images g where g.product_id = p.product_id) as n
  from products p where is_published and has_main_image) where 1 + n <= 1""",
    "select_by_category": f"""
with recursive tree as (
  select category_id from categories where name in ('ASIA', 'EUROPE', 'NATION_1')
  union select c.category_id from categories c join tree on c.parent_id = tree.category_id
) select {IDS} from products where category_id in (select category_id from tree)""",
    "select_all_published": f"select {IDS} from products where is_published",
    "select_with_images": f"select {IDS} from products where main_image_text is not null",
    "select_not_normalized": f"select {IDS} from products where main_image_text is not null and not main_image_normalized",
    "select_category_with_images": f"select {IDS} from products where has_main_image and category_id in {SUBTREE}",
    "select_selected_with_images": f"select {IDS} from products where has_main_image and product_id in {CONTEXT}",
    "select_unless_forced": f"select {IDS} from products where has_main_image and not main_image_normalized",
    "select_by_skus": f"""
select {IDS} from products where default_code in (
  select concat('SKU-', cast(l_partkey as string)) from lineitem where l_quantity = 50 and l_tax = 0)""",
    "select_images_by_ids": f"select {IDS} from products where has_main_image and product_id in {CONTEXT}",
    "pending_candidates": f"""
select candidate_id, product_id, source_url, role, confidence, has_white_background, image_width, image_height
from candidates where state = 'pending' and product_id in {CHOSEN}""",
    "job_candidates": """
select candidate_id, job_id, product_id, role, state from candidates
where job_id in (select s_suppkey from supplier where s_acctbal < 0)""",
    "product_candidates": f"""
select candidate_id, product_id, role, state from candidates where product_id in {CHOSEN}""",
    "cost_estimate": """
select count(*) as estimated_count, count(*) * 0.01e0 as estimated_cost from products where is_published""",
    "source_breakdown_estimate": """
with ring as (
  select image_id, (case when y < 1 then 1 else 0 end) + (case when y >= 23 then 1 else 0 end)
       + (case when x < 1 then 1 else 0 end) + (case when x >= 23 then 1 else 0 end) as wt,
       (case when y < 5 then 1 else 0 end) * ((case when x < 5 then 1 else 0 end) + (case when x >= 19 then 1 else 0 end)) as tw,
       (case when y >= 19 then 1 else 0 end) * ((case when x < 5 then 1 else 0 end) + (case when x >= 19 then 1 else 0 end)) as bw,
       least(r, g, b) as m, a from pixels
), pct as (
  select image_id, 100e0 * sum(case when a < 32 then wt else 0 end) / sum(wt) as clear,
         100e0 * sum(case when m >= 245 then wt else 0 end) / sum(wt) as white,
         100e0 * sum(case when m >= 245 then tw else 0 end) / sum(tw) as top,
         100e0 * sum(case when m >= 230 then bw else 0 end) / sum(bw) as bottom
  from ring group by image_id
), states as (
  select image_id, case when clear >= 80 then 'transparent' when white >= 85 and top >= 95 and bottom >= 80 then 'white' else 'complex' end as st from pct
), sel as (
  select product_id from products where has_main_image and not main_image_normalized
), counts as (
  select count(case when st = 'transparent' then 1 end) as t, count(case when st = 'white' then 1 end) as w, greatest(1, count(st)) as n
  from (select product_id from sel order by product_id limit 200) s left join states on image_id = product_id
), scaled as (
  select (select count(*) from sel) as estimated_count, cast(floor((select count(*) from sel) * t / n) as bigint) as estimated_transparent,
         cast(floor((select count(*) from sel) * w / n) as bigint) as estimated_white from counts
)
select estimated_count, estimated_transparent, estimated_white, estimated_count - estimated_transparent - estimated_white as estimated_complex from scaled""",
    "bulk_approve": """
select candidate_id, role, confidence, case when hit then 'approved' else state end as state, hit as newly_approved
from (select *, state = 'pending' and confidence >= 0.85e0 and role <> 'main' as hit from candidates)""",
    "bulk_apply_select": "select candidate_id, product_id, job_id, role from candidates where state = 'approved'",
    "review_transition": """
with acts as (
  select candidate_id, state as s0, case when state <> 'pending' then null when role = 'uncertain' then 'reject' when image_width < 800 then 'approve'
    when image_width < 1200 then 'apply' end as action,
    case when confidence < 0.6e0 then repeat('decode error ', image_height) end as error from candidates)
select candidate_id,
       case action when 'approve' then 'approved' when 'reject' then 'rejected'
         when 'apply' then case when error is null then 'applied' else 'failed' end else s0 end as state,
       case when action = 'apply' and error is not null then left(error, 255) end as rejection_reason
from acts""",
    "apply_main_guard": """
with m as (
  select c.candidate_id, c.product_id, p.has_main_image and p.main_image_normalized as locked,
         c.image_width % 7 = 0 as lost,
         row_number() over (partition by c.product_id, c.image_width % 7 = 0 order by c.confidence desc, c.candidate_id) as rn
  from candidates c join products p on p.product_id = c.product_id where c.state = 'approved' and c.role = 'main')
select candidate_id, product_id, case when lost or locked or rn > 1 then 'failed' else 'applied' end as state,
       case when lost then 'Candidate has no image data' when locked or rn > 1 then 'Main image already normalized — enable overwrite_existing_main to replace' end as rejection_reason from m""",
    "apply_gallery": """
select c.candidate_id, c.product_id, concat(p.name, ' - ', c.role) as name,
       cast(case c.role when 'angle' then 10 when 'detail' then 20 when 'in_use' then 30 when 'lifestyle' then 40 when 'accessory' then 50 else 99 end as int) as sequence,
       c.source_url as image_ref
from candidates c join products p on p.product_id = c.product_id where c.state = 'approved' and c.role <> 'main'""",
}
