import numpy as np
import pytest

from ledgerlark.llm.link_graph import DAMPING, ROUNDS, UrlRule, host_edges, judged, spread, url_host, url_path
from pyspark.sql import functions as F

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def rule_for(host, path):
    fits = [(len(t), t, v) for t, v in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme.org/x", "http://a.org", "http://a.org/", "HTTP://Sub.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
    "ftp://x.com/fr/?q#f", "http://x.com?x/fr/", "http://x.com/de/#a://b", "http://com/de/a", "http://y.net/p?u=http://a.org/", "http://ÄB.net/ä", "http://z.com/fr", "a://b://c/d",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1.0, "k") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string, trust double, rule string")


def test_parts_and_rules_of_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = [tuple(r) for r in df.select(url_host(F.col("url")), url_path(F.col("url"))).collect()]
    assert got == [split(u) for u in URLS]
    found = {r["page_id"]: r for r in judged(pages(spark, [(u, None) for u in URLS])).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        rule, verdict = rule_for(*split(url))
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (*split(url), rule)
        if rule:
            assert found[i]["verdict"] == verdict
        if not found[i]["host"]:
            assert found[i]["verdict"] == "allow"


def dense(edges, seeds, rounds=ROUNDS):
    """Both personalised ranks by matrix powers."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at, n = {h: i for i, h in enumerate(hosts)}, len(hosts)
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[at[a], at[b]] += x
    out = {}
    for k, m in enumerate((w, w.T)):
        share = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        start = np.zeros(n)
        for h, s in seeds.items():
            start[at[h]] = s[k]
        if start.sum():
            start /= start.sum()
        rank = start * (1 - DAMPING)
        for _ in range(rounds):
            rank = start * (1 - DAMPING) + DAMPING * share.T @ rank
        out[k] = rank / rank.sum() if rank.sum() else rank
    return {h: (out[0][at[h]], out[1][at[h]]) for h in hosts}


@pytest.mark.parametrize("seeds", [{"a": (3, 0), "c": (1, 2), "e": (0, 1)}, {"a": (0, 2)}, {}])
def test_ranks_equal_matrix_powers(spark, seeds):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 5.0), ("d", "e", 1.0), ("e", "b", 1.0), ("f", "e", 3.0), ("b", "g", 1.0)]
    got = spread(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust bigint, distrust bigint"))
    wanted = dense(edges, seeds)
    found = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    for h, (t, d) in wanted.items():
        assert found.get(h, (0, 0)) == pytest.approx((t, d), abs=1e-9)


def test_edges_are_links_between_hosts_and_domain_ties(spark):
    html = """<a href="http://B.net/x">1</a><a HREF='//b.net'>2</a><a href=https://c.example.net?q>3</a><a href="/own">4</a><a href="http://a.net/">5</a>"""
    df = spark.createDataFrame([("a.net", html), ("a.net", html), ("b.net", None), ("", html)], "host string, html string")
    got = {(r["src"], r["dst"]): r["weight"] for r in host_edges(df).collect()}
    assert got == {("a.net", "b.net"): 2.0, ("a.net", "c.example.net"): 2.0, ("c.example.net", "example.net"): 1.0, ("example.net", "c.example.net"): 1.0}
    assert ("a.net", "a.net") not in got and not any("" in k for k in got)


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    spam, good = '<a href="http://bad.com/de/">', '<a href="http://fine.net/">'
    rows = [("http://bad.com/de/1", None), ("http://friend.net/", spam), ("http://a.org/", good), ("http://fine.net/", None), ("http://lone.net/", None), ("http://friend.net/", spam)]
    found = {r["page_id"]: r["verdict"] for r in judged(pages(spark, rows)).collect()}
    assert found == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def test_empty_table_and_own_rules(spark):
    assert judged(pages(spark, [])).count() == 0
    only = judged(pages(spark, [("http://q.zz/a", None)]), (UrlRule("block", "zz/a"),)).collect()
    assert [(r["rule"], r["verdict"]) for r in only] == [("zz/a", "block")]


def test_small_ranks_and_far_hosts_are_judged_like_others(spark):
    from ledgerlark.llm.link_graph import TOLERANCE

    # 2,000 hosts link to bad, one page among 1,000,000 blocked ones
    edges = [(f"in{i}", "bad", 1.0) for i in range(2000)] + [("far0", "bad2", 1.0)] + [(f"far{i + 1}", f"far{i}", 1.0) for i in range(30)]
    seeds = [("bad", 0, 1), ("bad2", 0, 1), ("big", 0, 1_000_000)]
    found = {r["host"]: r for r in spread(
        spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trust bigint, distrust bigint"), rounds=None).collect()}
    assert 0 < found["in7"]["distrust"] < 5e-10 and found["in7"]["trust"] == 0
    assert found["far30"]["distrust"] == pytest.approx(found["far0"]["distrust"] * DAMPING**30, rel=10 * TOLERANCE)


def test_verdicts_do_not_depend_on_the_size_of_the_rank_or_the_distance(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    chain = [(f"http://c{i}.net/", link(f"c{i - 1}.net" if i else "bad.com")) for i in range(30)]
    # 31 hosts link to each of w0 to w6, so that the rank falls by as much at each level
    wide = [(f"http://w{k}.net/", link(f"w{k - 1}.net" if k else "bad.com")) for k in range(8)]
    wide += [(f"http://x{k}-{j}.net/", link(f"w{k}.net")) for k in range(8) for j in range(30)]
    rows = [("http://bad.com/de/1", None), *chain, *wide, ("http://lone.net/", None)]
    found = {r["host"]: r for r in judged(pages(spark, rows)).collect()}
    assert found["lone.net"]["verdict"] == "allow" and found["lone.net"]["distrust"] == 0
    assert {r["verdict"] for h, r in found.items() if h != "lone.net"} == {"block"}
    assert 0 < found["w7.net"]["distrust"] < 5e-10


def test_mixed_trust_and_distrust_follow_their_share(spark):
    # m links to bad and is linked from good: distrust of one seed page against trust of many
    edges = spark.createDataFrame([("m", "bad", 1.0), ("good", "m", 1.0), ("m", "good", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("good", 3, 0), ("bad", 0, 2)], "host string, trust bigint, distrust bigint")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in spread(edges, seeds, rounds=None).collect()}
    # m = d * good, good = (1 - d) + d * m / 2 (and bad the other half); distrust: bad -> m -> good -> m
    d = DAMPING
    good = (1 - d) / (1 - d * d / 2)
    trust = {"good": good, "m": d * good, "bad": d * d * good / 2}
    m = d * (1 - d) / (1 - d * d)
    distrust = {"bad": 1 - d, "m": m, "good": d * m}
    for h in ("good", "m", "bad"):
        assert got[h] == pytest.approx((trust[h] / sum(trust.values()), distrust[h] / sum(distrust.values())), rel=1e-4)


@pytest.mark.parametrize("cell_edges", [5, 40, 10_000])
def test_cells_of_any_size_settle_on_the_same_ranks(spark, cell_edges):
    rng = np.random.default_rng(4)
    # 60 hosts of 12 domains, one of which has half of all hosts, and a hub that everybody links to
    hosts = [f"h{i}.d{i % 12 if i % 2 else 0}.net" for i in range(60)]
    found = {(hosts[a], hosts[b]): float(rng.integers(1, 5)) for a, b in rng.integers(0, 60, (150, 2)) if a != b}
    found |= {(h, hosts[7]): 1.0 for h in hosts if h != hosts[7]}
    edges = [(*k, w) for k, w in sorted(found.items())]
    seeds = {hosts[3]: (2, 0), hosts[10]: (1, 1), hosts[20]: (0, 4)}
    got = {r["host"]: r for r in spread(
        spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust bigint, distrust bigint"),
        rounds=None, cell_edges=cell_edges).collect()}
    for h, (t, d) in dense(edges, seeds, 400).items():
        row = got.get(h, {"trust": 0.0, "distrust": 0.0})
        assert (row["trust"], row["distrust"]) == pytest.approx((t, d), rel=1e-4)


def test_very_long_page_and_rules_of_equal_length(spark):
    html = "".join(f'<a href="http://h{i % 3000}.net/{i}">' for i in range(60_000))
    df = spark.createDataFrame([("a.net", html)], "host string, html string")
    assert host_edges(df).where("src = 'a.net'").agg(F.count("dst"), F.sum("weight")).first()[:] == (3000, 3000.0)
    rules = (UrlRule("allow", "zz/a"), UrlRule("block", "zz/a"))
    assert judged(pages(spark, [("http://q.zz/a", None)]), rules).first()["verdict"] == "block"  # the last one listed
