"""Host reputation: parts, rules, shrinkage by hand, and the SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from lexiforge.llm import queries
from lexiforge.llm import url_reputation as ur

URLS = {
    "https://Www.Example.COM/De/x?q#f": ("www.example.com", "/De/x"),
    "http://a.net": ("a.net", ""),
    "x://h#f": ("h", ""),
    "no scheme/path": ("", ""),
    "a://b://c/d": ("b:", "//c/d"),
    "http://É.net/é\n/x?y": ("É.net", "/é\n/x"),
    "": ("", ""),
    None: ("", ""),
}
RULED = {
    "http://a.net/": ("net/", "block"),
    "http://a.net": (None, "allow"),
    "http://net/x": ("net/", "block"),
    "http://x.example.net/en/1": ("example.net/en/", "allow"),
    "http://xexample.net/en/1": ("net/", "block"),
    "http://example.com/de/": ("example.com/de/", "block"),
    "http://www.example.com/de": (None, "allow"),
    "http://b.org/fr/x": ("org/fr/", "allow"),
}


def judge(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "mine", 9) for i, u in enumerate(urls)], "page_id long, url string, verdict string, extra int")
    seen = spark.createDataFrame(list(outcomes), "host string, bad int")
    return {r.url: r for r in ur.judge(pages, seen).collect()}


def test_parts(spark):
    got = judge(spark, URLS)
    assert {u: (r.host, r.path) for u, r in got.items()} == URLS
    assert all(r.extra == 9 and r.verdict == "allow" for r in got.values() if r.rule is None)


def test_rules(spark):
    assert {u: (r.rule, r.verdict) for u, r in judge(spark, RULED).items()} == RULED


def test_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("co.uk",)], "h string")
    got = [tuple(r) for r in df.select(ur.domain_of(F.col("h")), ur.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("co.uk", "co.uk")]


def test_reputation_blocks_bad_hosts_and_shrinks_rare_ones(spark):
    outcomes = [("bad.x.com", 1)] * 60 + [("good.x.com", 0)] * 60 + [("rare.y.com", 1)] + [(f"h{i}.z.org", i % 5 == 0 and 1 or 0) for i in range(50)]
    outcomes += [(None, 1), ("good.x.com", None)]
    got = judge(spark, ["http://bad.x.com/", "http://good.x.com/", "http://rare.y.com/", "http://new.x.com/", "http://z/"], outcomes)
    assert {u: r.verdict for u, r in got.items()} == {"http://bad.x.com/": "block", "http://good.x.com/": "allow", "http://rare.y.com/": "allow", "http://new.x.com/": "allow", "http://z/": "allow"}


def test_shrinkage_by_hand(spark):
    outcomes = [("a.x.com", 1)] * 3 + [("a.x.com", 0)] + [("b.x.com", 0)] * 4
    rows = {r.host: r for r in ur.reputation(spark.createDataFrame(outcomes, "host string, bad int"))[1]["hosts"].collect()}

    def level(units, rates):
        q = sum((bad - n * p) ** 2 for (n, bad), p in zip(units, rates, strict=True) if n > 1)
        nn, n1 = (sum(n**e * p * (1 - p) for (n, _), p in zip(units, rates, strict=True) if n > 1) for e in (2, 1))
        k = min(max((nn - q) / (q - n1), 1), 1000) if q > n1 else 1000
        return [(k * p + bad) / (k + n) for (n, bad), p in zip(units, rates, strict=True)]

    whole = (3 + 1) / (8 + 2)
    suffix = level([(8, 3)], [whole])
    domain = level([(8, 3)], suffix)
    hosts = level([(4, 3), (4, 0)], domain * 2)
    assert [rows["a.x.com"].host_rate, rows["b.x.com"].host_rate] == pytest.approx(hosts)


def test_no_rows(spark):
    assert judge(spark, []) == {}


def test_repeated_rows_and_long_urls(spark):
    urls = ["http://a.com/" + "x" * 50_000] * 300 + ["http://" + "h" * 20_000 + ".net/"] + ["http://a.com/y"] * 300
    pages = spark.createDataFrame([(1, u) for u in urls], "page_id long, url string")
    got = ur.judge(pages, spark.createDataFrame([("a.com", 1)] * 90, "host string, bad int")).collect()
    assert len(got) == len(urls)
    assert {(r.host[:5], r.verdict) for r in got} == {("a.com", "block"), ("hhhhh", "block")}


def plain_verdicts(pages, labels):
    """The contract's rules and the method, page by page, in plain Python."""

    def split(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.match("[^?#]*", rest[len(host) :])[0]

    def parents(host):
        parts = host.split(".")
        n = 2 if ".".join(parts[-2:]) in ur.TWO_PART_SUFFIXES else 1
        return ".".join(parts[-n - 1 :]), ".".join(parts[-n:])

    seen = defaultdict(lambda: [0, 0])
    for _, url in pages:
        host, path = split(url)
        m = re.search(r"/([0-9]{1,18})(?:\.html|/)?$", path)
        if m and int(m[1]) in labels:
            seen[host][0] += 1
            seen[host][1] += labels[int(m[1])]

    def grouped(units, key):
        out = defaultdict(lambda: [0, 0])
        for u, (n, bad) in units.items():
            out[key(u)][0] += n
            out[key(u)][1] += bad
        return out

    def shrunk(units, rate_of):
        many = [(n, bad, rate_of(u)) for u, (n, bad) in units.items() if n > 1]
        q = sum((bad - n * p) ** 2 for n, bad, p in many)
        nn, n1 = (sum(n**e * p * (1 - p) for n, _, p in many) for e in (2, 1))
        k = min(max((nn - q) / (q - n1), 1), 1000) if q > n1 else 1000
        return {u: ((k * rate_of(u) + bad) / (k + n), k + n) for u, (n, bad) in units.items()}

    domains, suffixes = grouped(seen, lambda h: parents(h)[0]), grouped(seen, lambda h: parents(h)[1])
    whole = (sum(b for _, b in seen.values()) + 1) / (sum(n for n, _ in seen.values()) + 2)
    s = shrunk(suffixes, lambda _: whole)
    d = shrunk(domains, lambda u: s[parents(u)[1] if u.count(".") else u][0])
    h = shrunk(seen, lambda u: d[parents(u)[0]][0])
    out = []
    for i, url in pages:
        host, path = split(url)
        domain, suffix = parents(host)
        rate, n = h.get(host) or d.get(domain) or s.get(suffix) or (whole, 0)
        low = max(0, rate - ur.Z * (rate * (1 - rate) / (n + 1)) ** 0.5)
        fits = [(len(a + b), a + b, v) for a, b, v in ur.RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if host and low > ur.BAD_RATE else "allow")
        out.append((i, host, path, rule, verdict))
    return sorted(out)


def test_planted_outcomes(spark, tmp_path):
    """The query on tables whose outcomes follow the host: against plain Python and the SQL, with blocks by posterior."""
    r = random.Random(4)
    hosts = [f"h{i}.{d}" for d in ("good.com", "bad.com", "mixed.co.uk", "other.org") for i in range(6)] + ["one.example.net"]
    rates = {h: 0.9 if "bad" in h else 0.8 if h in ("h1.mixed.co.uk", "h2.good.com") else 0.1 for h in hosts}
    at = [r.choice(hosts + ["h0.bad.com"] * 12) for _ in range(1500)]
    pages = [(k, f"https://{h}/{r.choice(['en', 'fr', 'de'])}/{k}.html?x=1") for k, h in enumerate(at)] + [(9000, "http://new.bad.com/"), (9001, "http://new.org/x"), (9002, None)]
    labels = {k: int(r.random() < rates[h]) for k, h in enumerate(at) if r.random() < 0.5}
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = [(k, 1 - bad, 0) for k, bad in labels.items()]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(x) for x in queries.op5_url_filter(spark, str(tmp_path)).collect())
    assert got == plain_verdicts(pages, labels)
    by_method = Counter(v for *_, rule, v in got if rule is None)
    assert by_method["block"] > 400 and by_method["allow"] > 300
    assert ("block", "allow") == tuple({i: v for i, *_, v in got}[k] for k in (9000, 9001))
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows_of_duckdb(db, queries.oracle_sql()["op5_url_filter"]) == rows_of_spark(queries.op5_url_filter(spark, str(tmp_path)))


def test_sql(spark):
    name = "op5_url_filter"
    assert rows_of_spark(queries.queries()[name](spark, SMALL)) == rows_of_duckdb(database(SMALL), queries.oracle_sql()[name])
