"""Queries over product projections, selections and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.operators import products as P
from shelfsight.operators import raster as R
from shelfsight.operators import review as V
from shelfsight.operators import selection as S
from shelfsight.plans.registry import query
from shelfsight.plans.tables import Tables

IDS = ("product_id", "name", "default_code", "category_id")


# ---- computed columns ----

@query
def effective_manufacturer(t: Tables) -> DataFrame:
    return P.effective_manufacturer(t("products"), t("attribute_lines")).select("product_id", "effective_manufacturer")


@query
def effective_sku(t: Tables) -> DataFrame:
    return P.effective_sku(t("products")).select("product_id", "effective_sku")


@query
def gallery_enabled(t: Tables) -> DataFrame:
    return P.gallery_enabled(t("products"), t("categories")).select("product_id", "gallery_enabled")


@query
def candidate_counts(t: Tables) -> DataFrame:
    return P.candidate_counts(t("products").select("product_id"), t("candidates"))


@query
def image_count(t: Tables) -> DataFrame:
    return P.image_count(t("products").select("product_id", "has_main_image"), t("gallery_images"))


@query
def role_priority(t: Tables) -> DataFrame:
    return P.with_role_priority(t("candidates").select("candidate_id", "role"))


@query
def role_sequence(t: Tables) -> DataFrame:
    return P.with_role_sequence(t("candidates").select("candidate_id", "role"))


@query
def candidate_order(t: Tables) -> DataFrame:
    return P.candidate_order(t("candidates").select("candidate_id", "product_id", "role", "confidence"))


@query
def candidate_board(t: Tables) -> DataFrame:
    return P.candidate_board(t("candidates"))


# ---- selections ----

def _context(t: Tables) -> DataFrame:
    """Ids a user picked: products that customers keep returning, plus ids that do not exist."""
    return t.sql(
        "select l_partkey as product_id from lineitem where l_returnflag = 'R' and l_quantity >= 49 "
        "union all select o_orderkey + 1000000000 from orders where o_orderpriority = '1-URGENT'"
    )


def _chosen(t: Tables) -> DataFrame:
    return t.sql("select p_partkey as product_id from part where p_size = 7")


def _roots(t: Tables) -> DataFrame:
    """Two region roots and one leaf category."""
    return t.sql("select category_id from categories where name in ('ASIA', 'EUROPE', 'NATION_1')")


@query
def select_explicit(t: Tables) -> DataFrame:
    return S.explicit(t("products").select(*IDS), _context(t), _chosen(t))


@query
def select_missing_images(t: Tables) -> DataFrame:
    return S.missing_images(t("products")).select(*IDS)


@query
def select_single_image(t: Tables) -> DataFrame:
    return S.single_image(t("products"), t("gallery_images")).select(*IDS, "image_count")


@query
def select_by_category(t: Tables) -> DataFrame:
    return S.by_category(t("products").select(*IDS), t("categories"), _roots(t))


@query
def select_all_published(t: Tables) -> DataFrame:
    return S.all_published(t("products")).select(*IDS)


@query
def select_with_images(t: Tables) -> DataFrame:
    return S.with_images(t("products")).select(*IDS)


@query
def select_not_normalized(t: Tables) -> DataFrame:
    return S.not_normalized(t("products")).select(*IDS)


@query
def select_category_with_images(t: Tables) -> DataFrame:
    return S.category_with_images(t("products"), t("categories"), _roots(t)).select(*IDS)


@query
def select_selected_with_images(t: Tables) -> DataFrame:
    return S.selected_with_images(t("products"), _context(t)).select(*IDS)


@query
def select_unless_forced(t: Tables) -> DataFrame:
    return S.unless_forced(S.with_images(t("products")), force=False).select(*IDS)


@query
def select_by_skus(t: Tables) -> DataFrame:
    skus = t.sql("select concat('SKU-', cast(l_partkey as string)) as sku from lineitem where l_quantity = 50 and l_tax = 0")
    return S.by_skus(t("products").select(*IDS), skus)


@query
def select_images_by_ids(t: Tables) -> DataFrame:
    return S.images_by_ids(t("products"), _context(t)).select(*IDS)


@query
def pending_candidates(t: Tables) -> DataFrame:
    return S.pending_candidates(t("candidates"), _chosen(t))


@query
def job_candidates(t: Tables) -> DataFrame:
    jobs = t.sql("select s_suppkey as job_id from supplier where s_acctbal < 0")
    return S.job_candidates(t("candidates"), jobs).select("candidate_id", "job_id", "product_id", "role", "state")


@query
def product_candidates(t: Tables) -> DataFrame:
    return S.product_candidates(t("candidates"), _chosen(t)).select("candidate_id", "product_id", "role", "state")


@query
def cost_estimate(t: Tables) -> DataFrame:
    return S.cost_estimate(S.all_published(t("products")), "discover_only")


@query
def source_breakdown_estimate(t: Tables) -> DataFrame:
    """Products stand on the raster with the same id, so only part of the sample is decodable."""
    return S.source_breakdown(S.not_normalized(t("products")), t("pixels"), R.background_state, sample_size=200)


# ---- review queue ----

@query
def bulk_approve(t: Tables) -> DataFrame:
    return V.bulk_approve(t("candidates"), threshold=0.85, role_filter="gallery").select(
        "candidate_id", "role", "confidence", "state", "newly_approved"
    )


@query
def bulk_apply_select(t: Tables) -> DataFrame:
    return V.approved(t("candidates")).select("candidate_id", "product_id", "job_id", "role")


@query
def review_transition(t: Tables) -> DataFrame:
    actions = t.sql(
        "select candidate_id, case when role = 'uncertain' then 'reject' when image_width < 800 then 'approve' "
        "when image_width < 1200 then 'apply' end as action, "
        "case when confidence < 0.6 then repeat('decode error ', image_height) end as error "
        "from candidates where state = 'pending'"
    )
    return V.transition(t("candidates").select("candidate_id", "state"), actions).select(
        "candidate_id", "state", "rejection_reason"
    )


@query
def apply_main_guard(t: Tables) -> DataFrame:
    """Every seventh candidate lost its image."""
    candidates = V.approved(t("candidates")).withColumn("has_image_data", F.col("image_width") % 7 != 0)
    return V.apply_main_guard(candidates, t("products"))


@query
def apply_gallery(t: Tables) -> DataFrame:
    return V.apply_gallery(V.approved(t("candidates")), t("products"))
