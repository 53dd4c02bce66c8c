import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm.revisits import PERMITTED, canonical_url, merged_headers, resolved_revisits

COLUMNS = "record_id bigint, url string, captured_at bigint, kind string, status int, headers map<string,string>, payload string, base string, _block int"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "b", 5) for r in rows], COLUMNS)


def expected(rows, key):
    out = {}
    for i, url, at, kind, _, headers, _ in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items() if v is not None}
        earlier = [r for r in rows if r[3] == "response" and url is not None and at is not None and r[2] is not None and r[1] is not None and key(r[1]) == key(url) and r[2] < at]
        if not earlier:
            out[i] = "no_base", None
            continue
        base = max(earlier, key=lambda r: (r[2], r[0]))
        have = {k.lower(): v for k, v in (base[5] or {}).items() if v is not None}
        for name in ("etag", "last-modified"):
            if name in own and name in have:
                same = own[name].removeprefix("W/") == have[name].removeprefix("W/")
                out[i] = ("resolved", base[0]) if same else ("validator_mismatch", None)
                break
        else:
            out[i] = "no_validator", None
    return out


def random_rows(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        url = "http://Hot.example/a" if rng.random() < 0.4 else f"https://h{rng.randrange(6)}.example/p{rng.randrange(3)}?utm_source=x#y"
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", rng.choice(["d1", "d2", None]))) if v}
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, rng.choice([url] * 30 + [None]), rng.choice([rng.randrange(40)] * 30 + [None]), kind, 200 if kind == "response" else 304, headers, f"body {i}" if kind == "response" else None))
    return rows


@pytest.mark.parametrize("seed, partitions", [(1, 1), (1, 8), (2, 40), (3, 200)])
def test_bases_equal_brute_force_wherever_blocks_end(spark, seed, partitions):
    rows = random_rows(seed)
    key = lambda u: u.split("#")[0].split("://")[1].replace("?utm_source=x", "").lower()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = resolved_revisits(captures(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert {r["record_id"]: (r["outcome"], r["base_id"]) for r in found} == expected(rows, key)
    body = {r[0]: r[6] for r in rows}
    assert all(r["payload"] == body.get(r["base_id"]) and (r["status"] == 200) == (r["base_id"] is not None) for r in found)


def test_only_permitted_headers_are_merged(spark):
    stored = {"Content-Length": "5", "ETag": "a", "Vary": "x", "X-Own": "1"}
    fresh = {"content-length": "0", "etag": "b", "Expires": "e", "X-Own": "2", "X-New": "3"}
    row = spark.createDataFrame([(stored, fresh)], "s map<string,string>, f map<string,string>").select(merged_headers(F.col("s"), F.col("f"))).first()[0]
    assert row == {"content-length": "5", "etag": "b", "vary": "x", "x-own": "1", "expires": "e"}
    assert "content-length" not in PERMITTED


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://Example.COM:80?utm_source=a&b=1&utm_x=2#f", "example.com/?b=1"), ("https://e.com/A?gclid=3", "e.com/A"), ("e.com/x?", "e.com/x"),
        ("https://e.com:8080/?q=a#b?c", "e.com:8080/?q=a"), ("", "/"), (None, None),
    ]
    df = spark.createDataFrame([(u,) for u, _ in pairs], "url string")
    assert [r[0] for r in df.select(canonical_url(F.col("url"))).collect()] == [w for _, w in pairs]


def test_empty_table_and_null_headers(spark):
    assert resolved_revisits(captures(spark, [])).count() == 0
    rows = [(1, "http://a/b", 1, "response", 200, None, "x"), (2, "http://a/b", 2, "revisit", 304, None, None), (3, "http://a/b", 3, None, None, {}, None)]
    assert [(r["record_id"], r["outcome"]) for r in resolved_revisits(captures(spark, rows)).collect()] == [(2, "no_validator")]


def test_repeated_rows_are_resolved_each_for_itself(spark):
    one = (1, "http://a/b", 1, "response", 200, {"ETag": "x"}, "body")
    two = (2, "http://a/b", 2, "revisit", 304, {"ETag": "x"}, None)
    for rows, n in (([one, two, two], 2), ([one, one, two], 1), ([one, one, two, two], 2)):
        found = [(r["record_id"], r["outcome"], r["base_id"], r["payload"]) for r in resolved_revisits(captures(spark, rows)).collect()]
        assert found == [(2, "resolved", 1, "body")] * n
    # without ids: a revisit is resolved, a response is no base
    bare = [one, (None, *one[1:2], 3, *one[3:]), (None, *two[1:]), (None, two[1], 5, *two[3:])]
    found = resolved_revisits(captures(spark, bare)).collect()
    assert [(r["record_id"], r["outcome"], r["base_id"]) for r in found] == [(None, "resolved", 1)] * 2


def test_pages_given_twice_have_twice_the_rows(spark):
    from ledgerlark.llm.catalog import page_captures

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20)
    once = sorted(str(tuple(r)) for r in resolved_revisits(page_captures(pages)).drop("headers").collect())
    twice = sorted(str(tuple(r)) for r in resolved_revisits(page_captures(pages.unionByName(pages))).drop("headers").collect())
    assert len(once) == 40 and twice == sorted(once * 2)
