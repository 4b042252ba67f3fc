"""URL rules against a plain version: nested hosts and paths, odd URLs, nulls, hot hosts, many ranges."""

import random

import pytest

from wayflow.llm import url_rules

PAGES = "page_id long, url string, host string, rule string, salt long"
RULES = "host string, path string, verdict string, key string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host, path = split(url)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        _, _, _, rule, verdict = max(fits) if fits else (0, 0, 0, None, default)
        out.append((page, host, path, rule, verdict))
    return sorted(out, key=str)


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame([(k, u, "clash", "clash", 1) for k, u in rows], PAGES)
    named = spark.createDataFrame([(h, p, v, "clash") for h, p, v in rules], RULES)
    return sorted(map(tuple, url_rules.judge(pages, named, **options).collect()), key=str)


def urls(n, seed):
    r = random.Random(seed)
    hosts = ["net", "a.net", "b.a.net", "x.b.a.net", "ab.net", "a-b.net", "org", "a.org", "anet", "b.anet", "é.net", "a.net:80", "a.net.", ".net", "u@a.net", "\U0001f600.a.net"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "//", "/é"]
    out = [None, "", "no scheme", "://", "http://", "http://a.net", "HTTP://A.NET/A?b://c", "x://y://a.net/a", "http:///a", "http://a.net?x/a", "http://a.net#/a", "line\n://a.net/a\nb?", "http://a.net/" + "q" * 100_000]
    out += [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=1', '#f'])}" for _ in range(n)]
    out += ["http://hot.a.net/a/b"] * n  # a third has one URL
    return [(None if k % 50 == 0 else k // 2, u) for k, u in enumerate(out)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rules_are_those_of_a_plain_version(spark, parts):
    r = random.Random(parts)
    hosts = ["net", "a.net", "b.a.net", "ab.net", "org", "a.org", "é.net", "a.net."]
    rules = [(h, p, r.choice(["allow", "block"])) for h in hosts for p in r.sample(["", "/", "/a", "/a/", "/a/b", "/ab"], 3)]
    rows = urls(400, parts)
    assert judged(spark, rows, rules + rules[:3], parts=parts) == plain(rows, rules)


def test_rules_for_all_hosts_and_twice(spark):
    rows = urls(30, 1)
    rules = [("", "", "block"), ("a.net", "/a", "allow"), ("A.net", "/a", "block")]
    low = [(h.lower(), p, v) for h, p, v in rules]
    assert judged(spark, rows, rules, default="block") == plain(rows, low, "block")
    assert judged(spark, rows, [(None, None, "block")]) == plain(rows, [("", "", "block")])


def test_empty_tables(spark):
    assert judged(spark, [], list(url_rules.RULES)) == []
    rows = urls(5, 2)
    assert judged(spark, rows, []) == plain(rows, [])


def test_a_hot_host_is_spread_over_ranges(spark):
    rows = [(k, f"http://hot.net/{k}") for k in range(3000)] + [(k, f"http://h{k}.org/fr/") for k in range(1500)]
    pages = spark.createDataFrame([(k, u, None, None, None) for k, u in rows], PAGES)
    rules = spark.createDataFrame(list(url_rules.RULES), "host string, path string, verdict string")
    out = url_rules.judge(pages, rules, parts=16)
    sizes = [n for n in out.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert sum(sizes) == 4500 and len(sizes) >= 12 and max(sizes) < 4500 / 4
    assert out.where("rule = 'net/' AND verdict = 'block'").count() == 3000 and out.where("rule = 'org/fr/'").count() == 1500
