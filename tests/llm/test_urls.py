import math

from textlens.llm import urls
from tests.llm.data import documents

ODD = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://example.com/en/",
    "http://notexample.com/en/", "http://a.b.net/es/1?x=1&y=2#f", "http://net/fr/", "http://x.net?q=/es/", "http://x.net#/es/", "http://É.com/é",
    "http://a.com:80/", "x://y://z.com/", "http://a.com//en", "http://example.com/EN/", "ftp://www.example.com/en/" + "p/" * 3000, "http://sub.www.example.com/en/\nx",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]


def rule(host, path):
    best = None
    for says, text in urls.RULES:
        own, _, start = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best or (None, None)


def check(pages):
    given = {r.page_id: r.url for r in pages.collect()}
    got = urls.url_filter(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path = parts(given[r.page_id])
        text, says = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text), r
        assert r.verdict == (says or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    return got


def test_given_and_odd_urls(spark):
    odd = spark.createDataFrame([(100000 + i, u) for i, u in enumerate(ODD)], "page_id long, url string").selectExpr("*", "'x' AS html", "1 AS host", "2 AS label", "3 AS score")
    given = documents(spark, "pages").selectExpr("page_id", "url", "html", "1 AS host", "2 AS label", "3 AS score")
    check(given.union(odd).union(odd))
    check(odd.limit(0))
    assert {r.verdict for r in check(odd.filter("url LIKE 'http://a.com/'"))} == {"allow"}


def test_trees_learn_the_labels(spark):
    """On labelled urls kept from training the trees give the rules' verdict nearly always."""
    pages = documents(spark, "pages", "/root/testdata/sf0.1")
    host, path = urls.url_parts(urls.F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    _, says = urls.rule_of(urls.F.col("host"), urls.F.col("path"), urls.RULES)
    rows = urls.lexical(rows.withColumn("says", says).filter("says IS NOT NULL").withColumn("label", (urls.F.col("says") == "block").cast("int")))
    model = urls.learn(rows.filter("page_id % 3 <> 0"))
    out = model.trees.transform(urls.features(rows.filter("page_id % 3 = 0"), model.suffixes, model.segments))
    right, total = out.agg(urls.F.sum((urls.F.col("prediction") == urls.F.col("label")).cast("int")), urls.F.count("*")).first()
    assert right / total > 0.95


def test_entropy_of_whole_texts(spark):
    bits = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
    start = "http://" + "long." * 60 + "com/" + "p/" * 200
    given = ["", "a", "aaaa", "http://a.com/É𝄞𝄞", start + "a" * 900, start + "".join(chr(200 + i) for i in range(900)), "http://" + "a" * 256 + "xyz.com/"]
    host, path = urls.url_parts(urls.F.col("url"))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    rows = urls.lexical(pages.select("page_id", "url", host.alias("host"), path.alias("path"))).collect()
    for r in rows:
        assert abs(r.entropy - bits(r.url)) < 1e-9 and abs(r.host_entropy - bits(r.host)) < 1e-9, r.url[:40]
    assert len({round(r.entropy, 6) for r in rows if r.url.startswith(start)}) == 2
