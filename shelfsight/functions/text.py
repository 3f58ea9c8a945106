"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.functions.binding import let


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` drops blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The value, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First non-null, non-empty value, else the empty string."""
    return F.coalesce(*[filled(c) for c in cols], F.lit(""))


def norm_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def erase_separators(c: Column) -> Column:
    """Lower-case with white space, ``_`` and ``-`` removed: the form SKUs are compared in."""
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def contains_any(c: Column, tokens: tuple[str, ...]) -> Column:
    """True where the text holds any of the literal tokens, as one regex pass."""
    special = set(r"\.^$|?*+()[]{}")
    quoted = ["".join("\\" + ch if ch in special else ch for ch in token) for token in tokens]
    return c.rlike("|".join(quoted))


def _decode_numbers(value: Column) -> Column:
    """``&#8364;`` and ``&#x20AC;`` as characters; numbers outside the range of characters become U+FFFD."""
    parts = F.split(F.regexp_replace(value, r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});", "\u0001&#$1\u0001"), "\u0001")

    def character(part: Column) -> Column:
        hexed = F.regexp_extract(part, r"(?i)^&#x([0-9a-f]+)$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(part, r"^&#([0-9]+)$", 1)).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        wide = F.format_string("%08X", F.when(valid, code).otherwise(0xFFFD))
        return F.when(code.isNotNull(), F.decode(F.unhex(wide), "UTF-32")).otherwise(part)

    return F.when(F.contains(value, F.lit("&#")), F.array_join(F.transform(parts, character), "")).otherwise(value)


def unescape_html(c: Column) -> Column:
    """Decode the entities that occur in attribute values, numeric ones included; ``&amp;`` goes last."""

    def decode(value: Column) -> Column:
        decoded = _decode_numbers(value)
        for entity, char in (
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&"),
        ):
            decoded = F.replace(decoded, F.lit(entity), F.lit(char))
        return F.when(F.contains(value, F.lit("&")), decoded).otherwise(value)

    return let(c, decode)
