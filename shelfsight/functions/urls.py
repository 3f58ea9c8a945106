"""URL and address expressions.

Built on regular expressions rather than ``parse_url``, which returns null for
hosts with ``_`` and raises on malformed input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsight.functions.binding import let
from shelfsight.functions.text import norm_alnum

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# absolute paths that need no rewriting: no dot segments, no empty params, query or fragment
_PLAIN_PATH = r"^(?!//)(?!.*/\.)(?!.*[;?#](?:$|[;/?#]))/"
_AFTER_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"

# fixed values: host names that never leave the machine or its platform
BLOCKED_HOSTS = (
    "localhost", "localhost.localdomain", "metadata.google.internal", "metadata", "instance-data",
)

# fixed values: IPv4 blocks of the special-purpose registry that are not public,
# plus multicast and the reserved top block
NON_PUBLIC_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
# fixed values: the two public addresses inside 192.0.0.0/24
PUBLIC_V4 = ("192.0.0.9", "192.0.0.10")


def netloc(url: Column) -> Column:
    """Authority part with user info and port; empty when the URL has none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def hostname(url: Column) -> Column:
    """Lower-case host without user info, port and IPv6 brackets."""
    host = F.regexp_replace(F.lower(netloc(url)), r"^.*@", "")
    return F.regexp_replace(F.regexp_extract(host, r"^(\[[^\]]*\]|[^:]*)", 1), r"^\[|\]$", "")


def path(url: Column) -> Column:
    """Path without ``;params`` of the last segment, query and fragment."""
    whole = F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER_AUTHORITY + r"([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def robots_path(url: Column) -> Column:
    """Path and query as robots rules see it; an empty path counts as ``/``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), _AFTER_AUTHORITY, "")
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def host_contains_brand(url: Column, brand: Column) -> Column:
    """Brand, reduced to letters and digits, is non-empty and occurs in the reduced host."""
    key = norm_alnum(brand)
    return (key != "") & F.contains(norm_alnum(netloc(url)), key)


def host_matches_for_ranking(url: Column, manufacturer: Column) -> Column:
    """As above, but a manufacturer without letters or digits matches every host."""
    named = F.coalesce(manufacturer, F.lit("")) != ""
    return named & F.contains(norm_alnum(netloc(url)), norm_alnum(manufacturer))


def _join_segments(parts: Column) -> Column:
    """Resolve ``.`` and ``..`` over an array of path segments."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        shorter = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(empty)
        return F.when(seg == "..", shorter).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(parts, empty, step)
    # a final dot segment leaves a trailing slash
    closing = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    return F.regexp_replace(F.array_join(F.concat(folded, closing), "/"), "^(?!/)", "/")


def _without_dots(path_text: Column) -> Column:
    return F.when(
        F.contains(path_text, F.lit("/.")) & path_text.rlike(r"/\.{1,2}(/|$)"), let(F.split(path_text, "/", -1), _join_segments)
    ).otherwise(path_text)


def base_parts(base: Column) -> Column:
    """What resolving needs to know of a base URL; bind it once per page."""
    rest = F.regexp_replace(base, _AFTER_AUTHORITY, "")
    return F.struct(
        base.alias("url"),
        scheme(base).alias("scheme"),
        F.concat(scheme(base), F.lit("://"), netloc(base)).alias("origin"),
        F.regexp_extract(rest, r"^([^?#]*)", 1).alias("path"),
        F.regexp_replace(path(base), r"[^/]*$", "").alias("folder"),
        F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1).alias("query"),
    )


def resolve_from(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen from ``base_parts``.

    Covers references that are absolute, scheme-relative, absolute-path,
    relative-path, query-only, fragment-only and empty. A reference that
    repeats the scheme without an authority (``http:x``) is left alone.
    """
    clean = F.regexp_replace(F.coalesce(ref, F.lit("")), r"^[\x00-\x20]+|[\t\r\n]+", "")
    after = lambda text, head: F.substr(text, F.length(head) + 1)
    lone = lambda c, mark: F.when(c == mark, "").otherwise(c)

    def relative(r: Column) -> Column:
        unfragmented = F.substring_index(r, "#", 1)
        before_query = F.substring_index(unfragmented, "?", 1)
        params = F.when(F.contains(before_query, F.lit(";")), F.regexp_extract(before_query, r"(;[^/]*)$", 1)).otherwise("")
        pieces = F.struct(
            F.substr(before_query, F.lit(1), F.length(before_query) - F.length(params)).alias("path"),
            lone(params, ";").alias("params"),
            lone(after(unfragmented, before_query), "?").alias("query"),
            lone(after(r, unfragmented), "#").alias("fragment"),
        )
        return let(pieces, place)

    def place(p: Column) -> Column:
        # empty segments vanish from a merged path, except the first and the last
        merged = F.regexp_replace(F.concat(F.lit("/"), base["folder"], p["path"]), "/{2,}", "/")
        full = F.when(p["path"].startswith("/"), p["path"]).otherwise(merged)
        stay = F.concat(
            base["origin"], base["path"], F.when(p["query"] == "", base["query"]).otherwise(p["query"]), p["fragment"]
        )
        move = F.concat(base["origin"], let(full, _without_dots), p["params"], p["query"], p["fragment"])
        return F.when((p["path"] == "") & (p["params"] == ""), stay).otherwise(move)

    return let(
        clean,
        lambda r: F.when(r.rlike(_PLAIN_PATH), F.concat(base["origin"], r))
        .when(r == "", base["url"])
        .when(r.rlike("^//[^/?#]"), F.concat(base["scheme"], F.lit(":"), r))
        .when(F.contains(r, F.lit(":")) & r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .otherwise(relative(F.regexp_replace(r, "^//", ""))),
    )


def resolve(base: Column, ref: Column) -> Column:
    return let(base_parts(base), lambda b: resolve_from(b, ref))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def is_ipv4(host: Column) -> Column:
    return host.rlike(_V4)


def is_ipv6(host: Column) -> Column:
    """Shape check only: hex groups with ``:`` and an optional dotted tail."""
    return host.rlike(r"^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?:\.\d+\.\d+\.\d+)?$") | host.rlike(r"^::ffff:[\d.]+$")


def ipv4_number(host: Column) -> Column:
    """Address as a 32-bit number in a long; null unless it is a dotted quad."""
    octets = F.split(host, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.try_element_at(octets, F.lit(i + 1)).try_cast("long")
    return F.when(is_ipv4(host), number)


def _cidr(block: str) -> tuple[int, int]:
    address, bits = block.split("/")
    low = 0
    for octet in address.split("."):
        low = low * 256 + int(octet)
    return low, low + 2 ** (32 - int(bits)) - 1


def _v4_public(host: Column) -> Column:
    def judge(number: Column) -> Column:
        hidden = F.lit(False)
        for block in NON_PUBLIC_V4:
            low, high = _cidr(block)
            hidden = hidden | number.between(low, high)
        return ~hidden | number.isin(*[_cidr(a + "/32")[0] for a in PUBLIC_V4])

    return let(ipv4_number(host), judge)


def _v6_public(host: Column) -> Column:
    group = lambda pattern: F.conv(F.nullif(F.regexp_extract(host, pattern, 1), F.lit("")), 16, 10).try_cast("int")

    def judge(g: Column) -> Column:
        first, second = g["first"], F.coalesce(g["second"], F.lit(0))
        assigned = (first == 0x2001) & ((second < 0x200) | (second == 0xDB8))
        return F.coalesce(first.between(0x2000, 0x3FFF) & ~assigned & (first != 0x2002), F.lit(False))

    groups = F.struct(
        group(r"^([0-9a-f]{1,4}):").alias("first"), group(r"^[0-9a-f]{1,4}:([0-9a-f]{1,4})").alias("second")
    )
    return let(groups, judge)


def ip_is_public(host: Column) -> Column:
    """Whether an address literal is publicly routable; null for anything else.

    IPv6: only 2000::/3 is global unicast, less its protocol-assignment,
    documentation and 6to4 blocks; mapped IPv4 addresses are not public.
    """

    def judge(h: Column) -> Column:
        return F.when(is_ipv4(h), _v4_public(h)).when(is_ipv6(h), _v6_public(h))

    return let(host, judge)


def literal_is_safe(url: Column) -> Column:
    """Scheme, host name and address-literal part of the outbound guard.

    Names that are not address literals pass here and are judged by their
    resolved addresses.
    """
    allowed = let(
        hostname(url),
        lambda h: (h != "") & ~h.isin(*BLOCKED_HOSTS) & F.coalesce(ip_is_public(h), F.lit(True)),
    )
    return scheme(url).isin("http", "https") & allowed


def sitemap_host(domain: Column, strict_www: bool = False) -> Column:
    """Host in the form sitemap addresses are built from.

    The leading strip removes *any* run of ``w`` and ``.`` (``walmart.com``
    becomes ``almart.com``); ``strict_www`` removes only a ``www.`` prefix.
    """
    bare = F.when(F.contains(domain, F.lit("://")), F.coalesce(F.nullif(netloc(domain), F.lit("")), domain)).otherwise(domain)
    prefix = r"^www\." if strict_www else r"^[w.]+"
    return F.regexp_replace(F.regexp_replace(F.lower(bare), prefix, ""), r"^/+|/+$", "")
