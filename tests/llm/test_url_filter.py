from collections import Counter

import pytest

from meterbook.llm import queries
from meterbook.llm.url_filter import verdicts

RULES = list(queries._RULES) + [("a.b.example.org/x", "block"), (None, "block"), ("bare.test", None)]
URLS = [
    "http://Example.com/en/1",
    "https://www.EXAMPLE.com/en/9?q=/es/",
    "https://www.example.com/fr/9",
    "https://com/",
    "https://com",
    "https://example.com",
    "http://notexample.com/en/",
    "http://x.net/es/1#top",
    "http://x.net/es",
    "http://net/fr/",
    "http://c.a.b.example.org/xyz/",
    "http://a.b.example.org/y",
    "x.bare.test/none",
    "http://x.bare.test",
    "http://x.bare.test/p?x",
    "no url",
    "",
    None,
    "ftp://a.com://b.net/es/",
    "http:///path",
    "http://x.net/" + "es/" * 9000,
    "http://Ünï.com/é",
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in rules:
        if rule is None:
            continue
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, verdict or "block"))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("blocks", [1 << 16, 1])
def test_every_row_against_brute_force(spark, blocks):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "", ""), (None, URLS[0], "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = Counter(map(tuple, verdicts(pages, rules, blocks).collect()))
    assert got == Counter((r[0], *judged(r[1], RULES)) for r in rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    assert verdicts(pages, rules.limit(0)).first().verdict == "allow"
    assert verdicts(pages.limit(0), rules).collect() == []
