import random

from barloom.llm import url_rules

SCHEMA = "page_id long, url string"


def plain(url, rules):
    """Host, path, rule and verdict by looking at every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(((n, m, r.lower() if m == n else r, v) for n, m, r, v in fits), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], SCHEMA)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table, **kw).collect()}


def test_against_every_rule(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "com", "net", "", "é"])
    hosts = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    paths = lambda: "".join(rng.choice(["/", "/", "a", "é", "bc"]) for _ in range(rng.randint(0, 4)))
    rules = [(hosts(3), paths(), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"{rng.choice(['http://', 'HTTPS://', '://', 'mailto:'])}{rng.choice([hosts(4), hosts(4).upper()])}{paths()}{rng.choice(['', '?q=/a', '#/b', '?x#y'])}" for _ in range(400)]
    got = judged(spark, urls, rules)
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert len({x[2] for x in got.values()}) > 10


def test_odd_urls(spark):
    rules = [*url_rules.RULES, (None, "/", "block"), ("com", None, "block"), ("org", "/x", None)]
    urls = [None, "", "no scheme.com/", "http://", "http://com", "http://com/", "http://x.com?/en/", "ftp://Example.COM/en/", "a://b://c.com/", "http://" + "a." * 3000 + "com/" + "e/" * 20_000, "http://www.example.com/en/x", "http://m.www.example.com/en", "http://notexample.com/en/", "http://org/x"]
    got = judged(spark, urls, rules)
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert got[9][2:] == ("com/", "allow") and got[7][2:] == ("example.com/en/", "block") and got[10][2:] == ("www.example.com/en/", "allow") and got[4][2] is None


def test_hash_prefix_alone_does_not_decide(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PREFIX", 1)
    rules = [(f"h{i}.com", "/", "block") for i in range(200)]
    urls = [f"http://h{i}.com/" for i in range(0, 400, 2)]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_equal_rows_clashing_names_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(None, "http://x.net/es/", i, "r", "d") for i in range(500)], "page_id long, url string, row int, digest string, copy string")
    rules = spark.createDataFrame(url_rules.RULES + [("net", "/es/", "allow")], "host string, path string, verdict string")
    out = url_rules.judge(pages, rules)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {tuple(r) for r in out.collect()} == {(None, "x.net", "/es/", "net/es/", "block")} and out.count() == 500
    assert {(r.rule, r.verdict) for r in url_rules.judge(pages, rules.limit(0), default="block").collect()} == {(None, "block")}
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_join_is_on_the_prefix(spark):
    pages = spark.createDataFrame([(1, "http://x.net/es/")], SCHEMA)
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    plan = url_rules._judged(pages, rules, "allow", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "(prefix#" in plan and "CartesianProduct" not in plan and "Join Cross" not in plan
