"""Fixed vocabularies and the expressions that look values up in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: review order of candidate roles
ROLE_PRIORITY = {
    "main": 0, "angle": 1, "detail": 2, "in_use": 3, "lifestyle": 4, "accessory": 5, "uncertain": 9,
}
# fixed values: display order of gallery images
ROLE_SEQUENCE = {
    "main": 0, "angle": 10, "detail": 20, "in_use": 30, "lifestyle": 40, "accessory": 50,
}
# fixed values: closed state sets
CANDIDATE_STATES = ("pending", "approved", "applied", "rejected", "failed")
JOB_STATES = ("draft", "queued", "running", "paused", "done", "failed", "cancelled")
PIPELINES = ("discover_only", "discover_apply", "normalize_only", "full")


def lookup(key: Column, table: dict[str, int], default: int) -> Column:
    """Value of a small literal map as one CASE, codegen-friendly."""
    out = None
    for word, value in table.items():
        out = F.when(key == word, value) if out is None else out.when(key == word, value)
    return out.otherwise(default).cast("int")


def role_priority(role: Column) -> Column:
    return lookup(role, ROLE_PRIORITY, 9)


def role_sequence(role: Column) -> Column:
    return lookup(role, ROLE_SEQUENCE, 99)
