import random

from pyspark.sql import functions as F

from sidelight.llm import url_rules as ur

SCHEMA = "page_id long, url string, verdict int"


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for text, verdict in ur.LIST:
        at, start = text.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return host, path, best


def urls(n=400):
    rng = random.Random(1)
    out = [None, "", "no scheme/com/en/1", "http://", "HTTP://EXAMPLE.COM/en/7", "https://x.org?q=/es/", "http://É.net/de/1#/x", "a://b://c.com/en/1", "http://a\nb.com/en/3", "http://com/en/9", "http://notcom/en/1"]
    for _ in range(n):
        site = rng.choice(["example.com", "example.net", "example.org", "casino-win.example.org"])
        out.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'blog.a.'])}{site}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(100)}{rng.choice(['', '/', '.html', '?page=2', '#top'])}")
    return out


def test_hosts_paths_and_listed_verdicts(spark):
    rows = [(i, u, 0) for i, u in enumerate(urls())]
    out = ur.judge(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["page_id", "url", "verdict", "host", "path", "rule"]
    for r in out.collect():
        host, path, best = plain(r.url)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best and best[0])
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[1])


def plain_mined(rows, support, confidence):
    """Rules of (tokens, verdict) rows, by trying every combination."""
    from itertools import combinations

    n, tokens = len(rows), sorted({t for ts, _ in rows for t in ts})
    rules = {}
    for size in range(1, len(tokens) + 1):
        for ante in combinations(tokens, size):
            have = [v for ts, v in rows if set(ante) <= set(ts)]
            for verdict in ("allow", "block"):
                hits = have.count(verdict)
                if hits and hits / n >= support and hits / len(have) >= confidence:
                    rules[ante, verdict] = hits / len(have), hits / n
    better = lambda a, v: any(w == v and set(b) < set(a) and c >= rules[a, v][0] for (b, w), (c, _) in rules.items())
    return {k: x for k, x in rules.items() if not better(*k)}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(2)
    for share in (0.8, 0.93, 0.97):
        rows = []
        for _ in range(300):
            ts = [t for t in "abcde" if rng.random() < 0.5]
            rows.append((ts, "block" if {"a", "b"} <= set(ts) or "e" in ts and rng.random() < share else "allow"))
        mined = ur.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9)
        want = plain_mined(rows, 0.05, 0.9)
        assert {(a, v) for a, v, *_ in mined} == set(want) and ("a", "b") in {a for a, v in want if v == "block"}
        assert all(abs(c - want[a, v][0]) < 1e-9 and abs(s - want[a, v][1]) < 1e-9 for a, v, c, s in mined)


def test_verdicts_of_all_urls_against_brute_force(spark):
    rng = random.Random(12)
    sites = ["casino-win.example.com", "casino-top.example.com", "news.example.net", "x.example.org", "shop.site.org", "shop.site.net"]
    rows = []
    for i in range(500):
        lang = rng.choice(["en", "de", "es", "fr"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(sites)}/{lang}/{rng.randrange(90)}{rng.choice(['', '.html', '?page=2'])}", 0))
    rows += [(None, None, 0), (7, "none", 0), (7, rows[3][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.url: tuple(r.t) for r in df.select("url", ur.tokens(F.col("url"), ur.host_of(F.col("url")), ur.path_of(F.col("url"))).alias("t")).collect()}
    listed = [(found[u], plain(u)[2][1]) for _, u, _ in rows if plain(u)[2]]
    rules = plain_mined(listed, ur.SUPPORT, ur.CONFIDENCE)
    got = ur.judge(df).collect()
    assert len(got) == len(rows)
    unlisted = set()
    for r in got:
        best = plain(r.url)[2]
        fits = sorted((-c, -s, v) for (a, v), (c, s) in rules.items() if set(a) <= set(found[r.url]))
        assert r.verdict == (best[1] if best else fits[0][2] if fits else "allow"), r.url
        if not best:
            unlisted.add(r.verdict)
    assert unlisted == {"allow", "block"}


def test_index_picks_the_best_matching_rule():
    rules = [(("x",), "block", 0.9, 0.1), (("x", "y"), "allow", 0.95, 0.05), (("z",), "block", 0.95, 0.05)]
    index = ur.RuleIndex(rules)
    for found in [[], ["x"], ["x", "y"], ["y"], ["x", "y", "z"], ["z", "q"]]:
        fits = sorted((-c, -s, v) for a, v, c, s in rules if set(a) <= set(found))
        assert index.verdict(found) == (fits[0][2] if fits else "allow")


def test_empty_and_unlabelled(spark):
    assert ur.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    got = ur.judge(spark.createDataFrame([(1, "http://example.org/fr/1", 0), (2, None, 0)], SCHEMA)).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {(1, None, "allow"), (2, None, "allow")}


def test_query_on_driver_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    rows = ur.op7_url_rules(spark, sf).collect()
    assert len(rows) == n and all(r.verdict == dict(ur.LIST).get(r.rule, r.verdict) for r in rows)
