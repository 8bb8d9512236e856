import random
import re

import pytest

from slotcast.llm.queries import RULES
from slotcast.llm.urls import judge, rule_table


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, None, "allow")
    return host, path, best[1], best[2]


EDGE = [
    None, "", "no scheme", "http://", "http://com", "http://COM/", "https://a.b.Example.COM/en/x?q#f", "https://www.example.com/en/", "x://wwwexample.com/en/", "http://net/es/",
    "http://a.net/fr", "http://a.net/fr/", "http://example.com?x/en/", "http://u://v.com/", "http://é.com/É", "http://example.com:80/en/", "http://.com/", "http://" + "a." * 3000 + "com/" + "p/" * 5000, "\nhttp://x.net/es/\n",
]


@pytest.mark.parametrize("bytes_", [1 << 24, 0])
def test_verdicts_equal_a_plain_search(spark, bytes_):
    source = random.Random(1)
    hosts = ["example.com", "www.example.com", "net", "a.net", "org", "x.example.org", "Com"]
    urls = EDGE + [f"http://{source.choice(hosts)}{source.choice(['', '/', '/en/', '/en', '/es/1', '/fr/2'])}{source.choice(['', '?q', '#f'])}" for _ in range(200)]
    rows = [(i, u, "own") for i, u in enumerate(urls)] + [(None, "http://a.net/es/", None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = judge(pages, rule_table(spark, RULES), broadcast_bytes=bytes_).collect()
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out), key=repr) == sorted(((i, u, *plain(u, RULES)) for i, u, _ in rows), key=repr)


def test_long_lists_and_odd_rules(spark):
    rules = [("block", f"h{i}.org", f"/{i % 7}") for i in range(3000)] + [("allow", "h5.org", "/5"), ("block", None, "/"), ("block", "", "/")]
    rows = [(i, f"http://s.h{i}.org/{i % 5}") for i in range(0, 6000, 3)]
    out = judge(spark.createDataFrame(rows, "page_id long, url string"), rule_table(spark, rules)).collect()
    good = [r for r in rules if r[1]]
    assert sorted((r.page_id, r.rule, r.verdict) for r in out if r.rule) == sorted((i, *plain(u, good)[2:]) for i, u in rows if plain(u, good)[2])
    assert len(out) == len(rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in judge(pages, none).collect()] == [(1, "http://a.com/", "a.com", "/", None, "allow")]
    assert judge(pages.limit(0), rule_table(spark, RULES)).count() == 0


def test_no_python_in_the_plan(spark, plan):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    text = plan(judge(pages, rule_table(spark, RULES)))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_any_column_names(spark):
    names = ["_host", "_path", "_best", "entry", "labels", "a.b", "Host"]
    pages = spark.createDataFrame([(1, "http://x.example.com/en/1", *[777] * 7), (2, None, *[778] * 7)], ["page_id", "url", *names])
    out = judge(pages, rule_table(spark, RULES))
    assert out.columns == ["page_id", "url", *names[:-1], "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect())) == [
        (1, "http://x.example.com/en/1", *[777] * 6, "x.example.com", "/en/1", "example.com/en/", "block"), (2, None, *[778] * 6, "", "", None, "allow")]


def test_candidates_follow_the_hosts_of_a_url(spark, plan):
    """Rules of other hosts, of whatever lengths, add nothing to a url's candidates."""
    rules = [("block", f"h{i}.org", "/" + "p" * i) for i in range(400)] + [("block", "only.org", "/ab")]
    pages = spark.createDataFrame([(i, f"http://only.org/ab{'c' * 500}{i}") for i in range(50)], "page_id long, url string")
    out = judge(pages, rule_table(spark, rules))
    assert {(r.rule, r.verdict) for r in out.collect()} == {("only.org/ab", "block")} and out.count() == 50
