import random
import re

from tallygrove.llm import urlfilter as U

from ..compare import check

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x"), ("allow", "a.b", ""), ("block", "", "/q"), ("allow", "b", "/p"), ("block", "b", "/p"), (None, "null.org", None), ("allow", "EXAMPLE.ORG", "/F")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute(url):
    host, path = parts(url)
    best = None
    rules = {}
    for v, h, p in RULES:
        key = (re.sub("[A-Z]", lambda m: m.group().lower(), h or ""), p or "")
        rules[key] = max(rules.get(key, ""), v or "block")
    for (h, p), v in rules.items():
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h))
            if best is None or rank > best[0]:
                best = (rank, h + p, v)
    return (host, path, best[1] if best else None, best[2] if best else "allow")


def urls():
    rng = random.Random(1)
    hosts = ["example.net", "x.example.net", "notexample.net", "net", "a.b", "c.a.b", "b", "EXAMPLE.org", "null.org", "deep.er.null.org", "x..b", "b.", "", "é.net", "a.b:80", "u@a.b"]
    found = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x/y", "/p", "/pq", "/q?z", "?q", "#f", "/F", "/en?x", "/en/#", "//en/")]
    return [*found, None, "", "no scheme", "://", "a://b/p://c", "http://\nb/p\nq", "http://" + "s." * 3000 + "b/p", "http://b/" + "p" * 50_000, found[0]]


def test_equals_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(urls())] + [(None, "http://b/p"), (3, "http://b/p")]
    df = spark.createDataFrame([(i, u, 1, "k", "c") for i, u in rows], "page_id long, url string, rid int, key string, cell string")
    found = U.judge(df, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=repr) == sorted(((i, *brute(u)) for i, u in rows), key=repr)


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://b/p")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [(r.rule, r.verdict) for r in U.judge(df, none, default="block").collect()] == [(None, "block")]
    assert U.judge(df.limit(0), spark.createDataFrame(RULES, "verdict string, host string, path string")).count() == 0


def test_a_host_with_half_of_all_urls_is_swept_in_parts(spark, monkeypatch):
    """The largest cell is bounded by its share of the tasks, and the verdicts are those of one sweep."""
    seen = []
    own = U.settle

    def kept(df, name):
        out = own(df, name)
        if name == "url-salts":
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(U, "settle", kept)
    df = spark.range(4000).selectExpr("id as page_id", "case when id % 2 = 0 then concat('http://x.b/p', id) else concat('http://h', id, '.net/en') end as url")
    found = U.judge(df, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect()
    salts = {r["at"]: r["salts"] for r in seen}
    assert salts["b"] == 2000 * U.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")) // 4000 and len(found) == 4000
    assert {(r.page_id % 2, r.rule) for r in found} == {(0, "b/p"), (1, "net/")}


def test_query_equals_sql(spark):
    check(spark, "/root/testdata/sf0.001", U.query, U.ORACLE)
