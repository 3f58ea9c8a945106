import ipaddress
import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from shelfsight.functions import text as X
from shelfsight.functions import urls as U

BASES = [
    "http://a.example.com/en/7817?utm=1", "https://b.example.com/x/y/z.html#top", "https://c.example.com",
    "http://d.example.com/", "https://u:p@e.example.com:8443/p/q/;v=1?k=2", "http://h_1.example.com/a//b/c",
]
REFS = [
    "", "x.jpg", "./x.jpg", "../x.jpg", "../../../x.jpg", "/x.jpg", "/a/./b/../x.jpg", "//cdn.example.com/x", "?q=1", "#f",
    "?q=1#f", "x.jpg;v=1", "x;y=1/z.jpg", "a//b.jpg", "..", ".", "../", "./", "/", "https://o.example.com/a/../b", "data:image/png;base64,AA",
    "mailto:x@example.com", " x.jpg", "\tx.jpg\n", "a/b/../../c?x=../y", "/a//../b", "x.jpg?", "x.jpg#", "/x?", ";p", "/..", "/.hidden/x",
]


def test_resolve_agrees_with_urljoin(rows):
    rng = random.Random(7)
    segs = ["a", "b.c", "..", ".", "", "d;e", "f?g", "h#i"]
    refs = REFS + ["/".join(rng.choice(segs) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    pairs = [(b, r) for b in BASES for r in refs]
    got = rows("base string, ref string", *pairs).select("base", "ref", U.resolve(F.col("base"), F.col("ref")).alias("u")).collect()
    wrong = [(r.base, r.ref, r.u, urljoin(r.base, r.ref)) for r in got if r.u != urljoin(r.base, r.ref)]
    assert not wrong, [w[1:] for w in wrong[:12]]


def test_netloc_and_path_agree_with_urlparse(rows):
    urls = BASES + REFS + ["http://h_x.example.com:80/p;q?r", "HTTPS://[2001:db8::1]:9/x", "/only/path;a/b;c?d"]
    got = rows("u string", *[(u,) for u in urls if not u.strip() != u]).select(
        "u", U.netloc(F.col("u")).alias("n"), U.path(F.col("u")).alias("p")
    ).collect()
    for r in got:
        want = urlparse(r.u)
        assert r.n == want.netloc, r
        if want.scheme in ("", "http", "https"):
            assert r.p == want.path, r


def test_public_addresses_agree_with_ipaddress(rows):
    rng = random.Random(3)
    ips = ["10.0.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.9", "192.0.0.8", "198.19.1.1", "198.20.1.1", "100.64.0.1", "224.0.0.1",
           "255.255.255.255", "0.0.0.0", "8.8.8.8", "169.254.169.254", "192.0.2.1", "203.0.113.9", "::1", "::", "fe80::1", "fc00::1", "ff02::1",
           "2606:2800:220:1::1", "2001:db8::1", "2002::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "3fff:1::1"]
    ips += [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(300)]
    got = rows("ip string", *[(i,) for i in ips]).select("ip", U.ip_is_public(F.col("ip")).alias("ok")).collect()
    for r in got:
        ip = ipaddress.ip_address(r.ip)
        want = not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)
        assert r.ok == want, r
    words = rows("ip string", ("example.com",), ("010.0.0.1",), ("1.2.3",), ("256.1.1.1",))
    assert [r.ok for r in words.select(U.ip_is_public(F.col("ip")).alias("ok")).collect()] == [None] * 4


def test_literal_guard(rows):
    cases = {
        "http://example.com/": True, "ftp://example.com/": False, "http:///x": False, "https://LOCALHOST/": False,
        "http://user@127.0.0.1:80/": False, "http://[::1]/": False, "http://8.8.8.8/": True, "": False, "/relative": False,
        "http://metadata.google.internal/": False, "https://[2606:2800:220:1::1]/": True,
    }
    got = rows("u string", *[(u,) for u in cases]).select("u", U.literal_is_safe(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in got} == cases


def test_sitemap_host_strips_any_leading_w(rows):
    got = rows("h string", ("walmart.com",), ("www.acme.com",), ("https://www.x.org/y",), ("WWW.Acme.com/",)).select(
        U.sitemap_host(F.col("h")).alias("a"), U.sitemap_host(F.col("h"), strict_www=True).alias("b")
    ).collect()
    assert [tuple(r) for r in got] == [("almart.com", "walmart.com"), ("acme.com", "acme.com"), ("x.org", "x.org"), ("acme.com", "acme.com")]


def test_brand_without_letters(rows):
    got = rows("u string, b string", ("http://x.com/", "---"), ("http://x.com/", ""), ("http://acme-cdn.com/", "Ac Me")).select(
        U.host_contains_brand(F.col("u"), F.col("b")).alias("strict"), U.host_matches_for_ranking(F.col("u"), F.col("b")).alias("rank")
    ).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, False), (True, True)]


def test_norm_alnum_drops_accents(rows):
    got = rows("s string", ("Élan-Vital 9",), (None,)).select(X.norm_alnum(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == ["lanvital9", ""]
