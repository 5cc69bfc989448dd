import random

import pytest
from pyspark.sql import functions as F

from skysift.llm import bloom, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    end = min([i for i, c in enumerate(rest) if c in "?#" and i >= cut], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]


def plain(url, rules):
    host, path = split(url)
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:1:-1] if fit else (None, None)


URLS = [
    None, "", "no scheme.org/es/", "http://", "http://EXAMPLE.org/es/1", "https://a.example.org/es", "http://notexample.org/es/x", "http://example.org/en/1", "http://x.example.org/en/12?q=/es/",
    "http://example.org/en/2", "http://org/", "http://org", "http://org?x", "http://a.com/fr/#frag", "http://a.com/de/", "http://com/de/x", "http://b.net/de/", "x://y://com/fr/", "http://a..org//",
    "http://user@a.com:80/fr/", "http://a.com/FR/", "http://ÄÖ.com/fr/é", "http://a.com\n/fr/", "http://u.org/" + "p" * 50_000, "http://" + "a." * 5_000 + "com/fr/1", "http://www.listed.net/x?b=1&a=2#c", "http://listed.net/x?a=2&b=1&utm_source=q",
]
RULES = (*url_filter.RULES, ("block", "b.a.org", "/"), ("allow", "a.org", "/x/"), ("allow", "t.org", "/d"), ("block", "t.org", "/d"), ("block", "", "/"))


def judged(spark, urls, rules=RULES, listed=("https://m.listed.net:443/x/?b=1&a=2", None, "http://b.net/de", "http://b.net/de/")):
    pages = spark.createDataFrame([(i, u, "doc", "r", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, `a.b` int").repartition(3)
    table = spark.createDataFrame([(u,) for u in listed], "url string")
    out = url_filter.judge(pages, url_filter.rule_table(spark, rules) if rules else url_filter.rule_table(spark).limit(0), table, pages.columns)
    rows = out.select("doc.page_id", F.col("doc.host").alias("own"), "host", "path", "rule", "verdict", "listed").collect()
    assert all(r.own == "doc" for r in rows)
    return {r.page_id: r for r in rows}


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_matches_plain_rules(spark, monkeypatch, blocks):
    monkeypatch.setattr(bloom, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(url_filter.bloom, "build", lambda keys, f=bloom.build: f(keys, max_blocks=blocks))
    r = random.Random(1)
    urls = URLS + [f"http://{r.choice(['', 'b.', 'c.b.'])}{r.choice(['a', 'example', 't', 'z'])}.{r.choice(['org', 'com', 'net'])}/{r.choice(['', 'es/', 'en/1', 'x/', 'fr/', 'de/', 'd'])}{r.randrange(9)}" for _ in range(400)]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rule, verdict = plain(url, RULES)
        host, path = split(url)
        listed = url is not None and (url.startswith("http://www.listed.net") or url.startswith("http://listed.net") or (host, path.rstrip("/")) == ("b.net", "/de"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].listed) == (host, path, rule, listed), url
        assert got[i].verdict == (verdict or ("block" if listed else "allow"))


def test_no_rules_no_list_no_pages(spark):
    assert {r.verdict for r in judged(spark, URLS, (), ()).values()} == {"allow"}
    assert judged(spark, []) == {}


def test_repeated_rows_are_judged_each(spark):
    pages = spark.createDataFrame([(None, "http://a.com/de/1")] * 40 + [(7, None)] * 3, "page_id bigint, url string")
    rows = url_filter.judge(pages, url_filter.rule_table(spark), pages.limit(0)).select("doc.page_id", "verdict").collect()
    assert sorted(rows, key=str) == sorted([(None, "block")] * 40 + [(7, "allow")] * 3, key=str)


def test_bloom_holds_its_keys(spark):
    import numpy as np

    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    made = bloom.build(keys)
    assert made.might_hold(keys.toPandas().h.to_numpy()).all()
    others = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 100_000)
    assert made.might_hold(others).mean() < 0.01
    assert not bloom.build(keys.limit(0)).might_hold(others).any()
