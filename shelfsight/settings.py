"""Thresholds and switches of the engine, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: the documented defaults
    target_canvas_size: int = 1920
    padding_percent: int = 8
    bg_color: str = "#FFFFFF"
    jpeg_quality: int = 92
    output_format: str = "jpeg"
    white_threshold: int = 245
    white_bg_min_percent: int = 85
    max_images_per_product: int = 4
    min_image_width: int = 600
    min_confidence: float = 0.7
    auto_apply_confidence: float = 0.85
    request_delay_seconds: float = 2.0
    monthly_budget_usd: float = 50.0
    brand_attribute: str = "Brand"
    user_agent: str = "ProductImageBot/1.0"
    strict_white_main: bool = True
    recipe_cache: bool = True
    strict_brand_url_match: bool = True
    keep_backup: bool = True
    overwrite_existing_main: bool = False


DEFAULTS = Settings()

# fixed values: every stored setting and its default; the default's type is the setting's type
TYPED_DEFAULTS: dict[str, object] = {
    "classifier_api_key": "",
    "classifier_model": "small",
    "search_provider": "brave",
    "search_api_key": "",
    "removal_api_key": "",
    "render_api_key": "",
    "render_endpoint": "",
    "strict_white_main": True,
    "recipe_cache_enabled": True,
    "brand_attribute_name": "Brand",
    "strict_brand_url_match": True,
    "target_canvas_size": 1920,
    "padding_percent": 8,
    "bg_color": "#FFFFFF",
    "jpeg_quality": 92,
    "output_format": "jpeg",
    "white_threshold": 245,
    "white_bg_min_percent": 85,
    "force_normalize_existing": True,
    "max_images_per_product": 4,
    "min_image_width": 600,
    "removal_model": "birefnet-general",
    "overwrite_existing_main": False,
    "require_review": True,
    "min_confidence": 0.7,
    "user_agent": "ProductImageBot/1.0",
    "request_delay_seconds": 2.0,
    "concurrent_workers": 2,
    "monthly_budget_usd": 50.0,
    "alert_email": "",
    "keep_backup": True,
}
