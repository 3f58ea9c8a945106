"""Discovery over all pages at once against a loop that looks at one page after another."""

import random

from shelfsight.operators import rounds as W
from shelfsight.plans.tables import Tables

ANSWER = '{"page_is_correct_product": %s, "product_match_confidence": 0.9, "images": [{"url": "https://i/x.jpg", "role": "main", "confidence": 0.9}]}'


def _tables(rows, seed):
    rng = random.Random(seed)
    urls = [f"https://{h}.example.com/{i}" for h in ("plain", "recipe", "broken", "inner", "shut") for i in range(8)]
    pages = [(p, k, u, "search") for p in [*range(40), None] for k, u in enumerate(rng.sample(urls, rng.randint(0, 7)))]
    html = lambda u: '<img class="hero" src="/a.jpg">' if int(u[-1]) % 2 else "<p>none</p>"
    fetched = [(u, 404 if u.endswith("7") else 200, "text/html", html(u)) for u in urls]
    text = {(p, u): rng.choice([ANSWER % "true", ANSWER % "false", ANSWER % "false", "no json", None]) for p, _, u, _ in pages if p is not None}
    answers = [(p, u, t) for (p, u), t in text.items() if rng.random() < 0.9]
    hosts = [f"{h}.example.com" for h in ("plain", "recipe", "broken", "inner", "shut")]
    tables = (
        rows("product_id int, page_pos int, page_url string, found_by string", *pages),
        rows("url string, status int, content_type string, html string", *fetched),
        rows("host string, ip string", *[(h, "10.0.0.1" if h.startswith("inner") else "93.184.216.34") for h in hosts]),
        rows("host string, agent string, ord int, allow boolean, path string", ("shut.example.com", "*", 0, False, "/")),
        rows("domain string, recipe_built boolean, active boolean, main_image_selector string, gallery_image_selector string, image_url_attribute string, excluded_url_patterns string",
             ("recipe.example.com", True, True, "img.hero", "", "src", ""), ("broken.example.com", True, True, "img:first", "", "src", "")),
        rows("product_id int, page_url string, text string", *answers),
    )
    return pages, {(p, u): t for p, u, t in answers}, tables


def _outcome(product, url, answers):
    host, odd = url.split("/")[2].split(".")[0], int(url[-1]) % 2
    if host in ("inner", "shut") or url.endswith("7"):
        return {"inner": "refused", "shut": "robots"}.get(host, "unusable")
    if host == "recipe" and odd:
        return "recipe"
    if (product, url) not in answers:
        return "unanswered"
    text = answers[product, url]
    return "unreadable" if not text or "{" not in text else "accepted" if "true" in text else "rejected"


def test_all_pages_at_once_equal_one_after_another(rows, monkeypatch):
    calls, look = [], W.look_at
    monkeypatch.setattr(W, "look_at", lambda *a, **b: calls.append(1) or look(*a, **b))
    pages, answers, tables = _tables(rows, 3)
    for n in (5, 2):
        want, done = [], set()
        for product, k, url, _ in sorted(pages, key=lambda p: (p[0] is None, p[0], p[1])):
            if product not in done and k < n:
                want.append((product, k, url, found := _outcome(product, url, answers)))
                if found in W.SETTLED and product is not None:
                    done.add(product)
        looked = W.discovery_rounds(*tables, rounds=n).collect()
        got = [(r.product_id, r.page_pos, r.page_url, r.outcome) for r in looked]
        assert sorted(map(str, got)) == sorted(map(str, want)) and {w[3] for w in want} >= {"recipe", "accepted", "rejected", "unreadable"}
        assert all(r.recipe_failed == ("broken" in r.page_url and r.outcome not in ("unusable",)) for r in looked)
        assert all(bool(r.images) == (r.outcome in W.SETTLED) for r in looked)
    assert len(calls) == 2  # pages and answers are dealt out once a run, not once a round


def test_a_stored_relation_stands_for_its_statement(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    held = t.storing("page_domains")
    assert sorted(map(tuple, held("site_ips").collect())) == sorted(map(tuple, t("site_ips").collect()))
    assert "lineitem" not in held("site_ips")._jdf.queryExecution().optimizedPlan().toString() and not t.stored
