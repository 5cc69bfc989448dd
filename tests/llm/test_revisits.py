import random

import pytest

from skysift.llm import revisits

SCHEMA = "record_id bigint, kind string, url string, ts bigint, etag string, last_modified string, headers map<string,string>, digest string, status int, canonical string"


def test_canonical_urls(spark):
    cases = {
        "http://www.A.example/x/?utm_source=f&b=2&a=1#top": "a.example/x?a=1&b=2", "HTTPS://m.a.example:443/x": "a.example/x", "https://a.example": "a.example",
        "https://a.example/X.html?ref=y": "a.example/X.html", "http://a.example:8080/?q": "a.example:8080?q", "": "", "no scheme": "", None: None,
    }
    rows = spark.createDataFrame([(u, c) for u, c in cases.items()], "u string, c string").withColumn("got", revisits.canonical_url("u")).collect()
    assert all(r.got == r.c for r in rows), rows


def plain(rows):
    weak = lambda t: t[2:] if t and t.startswith("W/") else t
    out = []
    for r in rows:
        if r[1] != "revisit":
            continue
        before = [x for x in rows if x[1] == "response" and None not in (r[2], r[3]) and x[2] == r[2] and x[3] is not None and (x[3], x[0]) < (r[3], r[0])]
        found, own = max(before, key=lambda x: (x[3], x[0]), default=None), r[6] or {}
        if not found:
            status = "no_response"
        elif r[4] is None and r[5] is None:
            status = "unvalidated"
        else:
            status = "resolved" if (weak(r[4]) == weak(found[4]) if r[4] is not None else r[5] == found[5]) else "mismatch"
        if status in ("resolved", "unvalidated"):
            fresh = {k: v for k, v in own.items() if k in revisits.PERMITTED}
            out.append((r[0], status, found[0], found[7], sorted({**(found[6] or {}), **fresh}.items())))
        else:
            out.append((r[0], status, None, None, sorted(own.items())))
    return sorted(out, key=str)


@pytest.mark.parametrize("seconds", [1, 7, 10_000])
def test_matches_search(spark, seconds):
    r = random.Random(seconds)
    rows = []
    for i in range(400):
        url = r.choice(["http://a.example/1", "http://a.example/1", "http://b.example/2", "http://c.example/3", None])
        headers = r.choice([None, {}, {"etag": f"e{i}", "server": "x", "content-length": "9"}, {"expires": "1", "content-type": "t"}])
        rows.append((i, r.choice(["response", "revisit"]), url, r.choice([None, *range(40)]), r.choice([None, "t1", "W/t1", "t2"]), r.choice([None, "m1", "m2"]), headers, f"d{i}", 1, "mine"))
    rows.append(next(x for x in rows if x[1] == "revisit"))
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA), seconds).collect()
    assert sorted(((x.record_id, x.status, x.refers_to, x.digest, sorted(x.headers.items())) for x in got), key=str) == plain(rows)


def test_empty_table(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    assert revisits.captures(spark.createDataFrame([(1, None, None)], "page_id bigint, url string, html string")).count() == 5
