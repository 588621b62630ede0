import numpy as np

from aeroledger.llm.url_filter import build_cascade, judge_urls

RULES = [("allow", "org/"), ("block", "a.org/x"), ("allow", "a.org/xy"), ("block", "org/z"), ("allow", "b.com/"), ("block", "b.com/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3:]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), -len(h), rule, verdict == "allow"))
    if fits:
        best = min(fits)
        blocks = any(f[:3] == best[:3] and not f[3] for f in fits)
        return host, path, best[2], "block" if blocks else "allow"
    listed = (host == "bad.net" or host.endswith(".bad.net")) and path.startswith("/")
    return host, path, None, "block" if listed else "allow"


def test_equals_brute_force(spark):
    hosts = ["a.org", "A.ORG", "www.a.org", "ba.org", "org", "b.com", "x.b.com", "bad.net", "www.bad.net", "good.net", "", "é.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x", "/xy", "/xyz?q=/x", "/z#x", "?x/", "#/x", "/Z", "/x://b.com/")]
    urls += [None, "", "a.org/x", "://a.org/x", "http:/a.org/x", "http://" + "a." * 50 + "org/x", "http://a.org/" + "y" * 50_000, urls[3]]
    rows = [(i, u, "<p>", "r", 1) for i, u in enumerate(urls)] + [(None, urls[2], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string, h1 int")
    found = judge_urls(pages, RULES, ["bad.net/"]).collect()
    assert len(found) == len(rows)
    for r in found:
        url = urls[2] if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(url), url


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert judge_urls(none, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    assert [tuple(r) for r in judge_urls(one, []).collect()] == [(1, "a.org", "/x", None, "allow")]


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS h1", "xxhash64(id, 1) AS h2", "id")
    listed = keys.where("id % 7 = 0").select("h1", "h2")
    cascade = build_cascade(keys.select("h1", "h2"), listed)
    got = np.array(keys.collect(), dtype=np.int64)
    assert (cascade.holds(got[:, 0], got[:, 1]) == (got[:, 2] % 7 == 0)).all()
    assert len(cascade.levels) > 1
