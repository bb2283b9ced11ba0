"""URL filters against a plain search over the rules, for both ways of looking up."""

import random
import re

import pytest

from spanforge.llm import url_filter as u

URLS = [None, "", "no scheme", "http://", "://", "https://Org", "https://ORG/", "https://a.Example.ORG/es/1?x", "https://example.org/en/10#t", "http://b.c.com/fr/", "http://com/de/9", "http://xcom/fr/1", "http://a.com:80/fr/", "http://u@a.com/fr/1", "x://y://a.com/fr/", "http://.org/", "http://org./", "http://é.org/é/", "http://a.org\n/x\ny?z", "https://example.org/es", "https://a.org/" + "s/" * 3000, "http://" + "a." * 500 + "org/", "https://example.org/es//x"]


def plain(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_rules_and_random_rules(spark, most):
    rnd = random.Random(most)
    label, segment = lambda: rnd.choice("a b c org com".split()), lambda: rnd.choice(["", "a", "ab", "abc", "b"])
    host, path = lambda: ".".join(label() for _ in range(rnd.randint(1, 3))), lambda: "/".join([""] * rnd.randint(0, 1) + [segment() for _ in range(rnd.randint(1, 3))])
    for rules in (u.RULES, [(host(), path(), rnd.choice(u.VERDICTS)) for _ in range(60)]):
        urls = [*URLS, *(f"http://{host()}{path() if rnd.random() < 0.9 else ''}" for _ in range(400))]
        pages = spark.createDataFrame([(i, x, "old") for i, x in enumerate(urls + urls[:9])], "page_id long, url string, host string").repartition(3)
        out = u.filter_urls(pages, spark.createDataFrame(rules, u.RULE_SCHEMA), trie_bytes=most)
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        got = {r["page_id"]: tuple(r)[2:] for r in out.collect()}
        assert got == {i: plain(x, rules) for i, x in enumerate(urls + urls[:9])}


def test_odd_rules(spark):
    """Nulls are no rule, hosts are lower-cased, a block goes before an allow of the same text, an unknown verdict is an error."""
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    rules = spark.createDataFrame([("A.org", None, "allow"), ("a.ORG", "", "block"), (None, "/", "block"), ("", "", "block"), ("b.net", "/", None)], u.RULE_SCHEMA)
    for most in (1 << 26, 0):
        got = [tuple(r)[2:] for r in u.filter_urls(pages, rules, default="none", trie_bytes=most).orderBy("page_id").collect()]
        assert got == [("a.org", "/x", "a.org", "block")] * 2 + [("b.net", "/", None, "none")]
        assert [r["rule"] for r in u.filter_urls(pages, rules.limit(0), trie_bytes=most).collect()] == [None] * 3
        assert u.filter_urls(pages.limit(0), rules, trie_bytes=most).count() == 0
    with pytest.raises(ValueError, match="allow or block"):
        u.filter_urls(pages, spark.createDataFrame([("a", "", "deny")], u.RULE_SCHEMA))
