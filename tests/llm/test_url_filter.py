import random

from cohortkit.llm import url_filter as uf

PAGES = "page_id long, url string, host string, rule string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def urls():
    rnd = random.Random(6)
    out = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/x?y://z#q", "x://example.org", "x://example.org/en/1",
           "x://example.org/en/", "x://notexample.org/es/", "x://org/es/", "x://.org/", "x://a..org/", "x://org./", "x://com/de/fr/",
           "x://a.com?de/", "x://a.com#/de/", "x://a.com/de", "x://a.b.c.d.com/fr/\n", "x://é.org/", "http://a.net/" + "p" * 30000,
           "x://ÀB.com/fr/x", "x://user@example.org:80/es/"]
    hosts = ["example.org", "a.example.org", "b.a.example.org", "org", "com", "x.com", "net", "exampleXorg", "zexample.org"]
    for _ in range(400):
        out.append(f"http://{rnd.choice(hosts)}/{rnd.choice(['es', 'en', 'fr', 'de', ''])}/{rnd.randrange(30)}")
    return out + ["http://example.org/es/1"] * 300  # a hot url


RULES = uf.RULES + [("a.example.org", "/", "block"), ("example.org", "/es/1", "allow"), ("org", "/", "allow"),
                    ("b.a.example.org", "", "allow"), ("net", "/p", "block"), ("example.org", "/es/", "allow")]


def test_matches_brute_force(spark):
    for rules in (uf.RULES, RULES):
        df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls())], PAGES).repartition(5)
        got = uf.judge_urls(df, uf.rules_table(spark, rules)).collect()
        assert len(got) == len(urls())
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls()[r.page_id], rules), urls()[r.page_id]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "x://a.org/", "", ""), (None, None, "", ""), (1, "x://a.org/", "", "")], PAGES)
    rules = uf.rules_table(spark, uf.RULES)
    assert uf.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in uf.judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}
    assert sorted((r.page_id or 0, r.rule or "") for r in uf.judge_urls(df, rules).collect()) == [(0, ""), (1, "org/"), (1, "org/")]


def test_null_rules_are_ignored(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("org", None, "block"), ("org", "/", "allow")],
                                  "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "x://a.org/", "", "")], PAGES)
    assert [r.verdict for r in uf.judge_urls(df, rules).collect()] == ["allow"]
