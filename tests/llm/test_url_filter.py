import random

import pytest

from spindrift.llm import op_url_filter
from spindrift.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "://", "https://EXAMPLE.com/en/7?x#y", "http://a.example.com/en/70", "http://a.com/en/", "http://a.com/en", "http://com/en/x", "http://notcom/en/x", "x://b.net/de/8", "x://example.net/de/8/9", "x://example.net/de/81",
    "x://example.net/de/7", "http://org/es/#", "http://www.org?/es/", "http://a.b.c.org/es/1://q", "http://a.org/ES/", "http://com./en/", "http://.com/en/", "http://ex\u00c4mple.com/en/\u00e9", "http://a.com/en/" + "x/" * 50_000, "ftp://u:p@a.com:80/en/", "http://a.com//en/",
]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", ""), ("allow", "b.org", "/e"), ("allow", "org", "/es/"), ("block", "org", "/es/"), ("allow", "a.com", "/"), ("block", "net", "/de/8"), ("allow", "example.net", "/d")]


def brute(url, rules, default="allow"):
    """Every rule tried on the whole url."""
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, rule, action = max(fits) if fits else (None, default)
    return host, path, rule, action


@pytest.mark.parametrize("rules", [op_url_filter.RULES, RULES, []])
def test_against_brute_force(spark, rules):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(3, "http://a.com/en/", "z"), (None, "http://a.com/en/", "z")], "page_id long, url string, host string")
    rows = U.judge_urls(spark, df, rules).collect()
    assert len(rows) == len(URLS) + 2 and all(r.host == "z" for r in rows)
    for r in rows:
        assert (r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) == brute(r.url, rules)
    assert U.judge_urls(spark, df.limit(0), rules).count() == 0


def test_random_rules_and_the_join(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "x"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "b", "/a/", "é"]) for _ in range(rng.randrange(5)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    urls = [f"http://{host()}/{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(500)] + URLS
    df = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").repartition(3)
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    one = {r.page_id: (r.j.host, r.j.path, r.j.rule, r.j.verdict) for r in U.judge_urls(spark, df, rules, result="j").collect()}
    two = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls_by_join(df, spark.createDataFrame(rules, "action string, host string, path string"), "page_id").collect()}
    assert one == want == two


def test_the_join_keeps_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://b.org/x"), (None, "http://a.com/en/"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "com", "/en/"), ("block", "com", "/en/")], "action string, host string, path string")
    rows = U.judge_urls_by_join(df, rules, "page_id").collect()
    assert sorted(((r.page_id, r.host, r.verdict) for r in rows), key=repr) == [(1, "a.com", "block"), (1, "b.org", "allow"), (None, "", "allow"), (None, "a.com", "block")]


def test_a_taken_result_name_is_an_error(spark):
    with pytest.raises(ValueError, match="exists"):
        U.judge_urls(spark, spark.createDataFrame([("u", 1)], "url string, judged int"), RULES)
