import re

from tessera.llm import url_filter
from tests.llm.helpers import table


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for what, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return best or (None, None)


def check(pages):
    urls = [r.url for r in pages.select("url").collect()]
    rows = url_filter.filter_urls(pages).collect()
    assert len(rows) == len(urls)
    want = sorted(((*split(u), rule(*split(u))[1] or "") for u in urls))
    assert sorted((r.host, r.path, r.rule or "") for r in rows) == want
    for r in rows:
        what = rule(r.host, r.path)[0]
        assert r.verdict == (what or ("block" if r.score > 0.5 else "allow")) and 0 <= r.score <= 1
    return rows


def test_pages(spark):
    check(table(spark, "pages"))


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://a.example.com/en/", "http://notexample.com/en/", "http://x.net/fr/1", "net", "a://b://c/d", "http://h?q", "http://h#f", "http://é.org/ü\nx", "http://long.net/es/" + "a" * 200_000, "http://x.net/fr/1"]
    pages = spark.createDataFrame([(i, u, "x", 1, 0.5) for i, u in enumerate(urls)], "page_id long, url string, host string, grams int, score double")
    check(pages)
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_labelled_urls_are_learned(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(url_filter.LABELLED)], "page_id long, url string")
    got = {r.page_id: r.score > 0.5 for r in url_filter.filter_urls(pages, rules=()).collect()}
    assert sum(got[i] == bool(label) for i, (_, label) in enumerate(url_filter.LABELLED)) >= 0.95 * len(got)
    new = [("http://mega-casino.example/free-spins/jackpot", "block"), ("http://cheap-viagra-pills.example/buy", "block"), ("https://library.example/catalogue/history", "allow"), ("https://docs.example/guide/api/index.html", "allow")]
    rows = url_filter.filter_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(new)], "page_id long, url string"), rules=()).collect()
    assert {r.page_id: r.verdict for r in rows} == {i: v for i, (_, v) in enumerate(new)}


def test_scores_against_a_plain_regression(spark):
    import math
    from collections import Counter

    pages = table(spark, "pages").select("page_id", "url")
    hashing, model = url_filter.train(spark)
    bucket: dict = {}
    for r in url_filter.filter_urls(pages).orderBy("page_id").limit(12).collect():
        counts: Counter = Counter()
        for letter, part in (("h", r.host), ("p", r.path.lower())):
            marked = f"^{part}$"
            for n in url_filter.GRAM_SIZES:
                counts.update(letter + marked[i : i + n] for i in range(max(1, len(marked) - n + 1)))
        for g in counts:
            bucket.setdefault(g, hashing.indexOf(g))
        margin = model.intercept + sum(n * model.coefficients[bucket[g]] for g, n in counts.items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
