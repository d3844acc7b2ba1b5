"""PageRank vectors, crawl control rules, sources and streams."""

import json

import duckdb
import pytest
from compare import rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from lexiforge.operators import crawl, graph
from lexiforge.plans import registry
from lexiforge.sources import files
from lexiforge.streaming import incremental

PAGES = [("A", ["B", "C", "X"]), ("B", ["C", "C"]), ("C", []), ("D", ["A"])]


def ranks(df):
    return {r.url: r.pr for r in df.collect()}


def test_pagerank_vector(spark):
    pages = spark.createDataFrame(PAGES, "url string, links array<string>")
    assert ranks(graph.iterate(pages, 1)) == pytest.approx({"A": 0.368354430, "B": 0.196202532, "C": 0.325316456, "D": 0.110126582}, abs=1e-8)
    done = ranks(graph.pagerank(pages))
    assert done == pytest.approx({"A": 0.278052, "B": 0.232526, "C": 0.352691, "D": 0.136731}, abs=2e-6)
    assert sum(done.values()) == pytest.approx(1)


def test_N12_null_links_and_no_pages(spark):
    pages = spark.createDataFrame([("A", None), ("B", ["A"])], "url string, links array<string>")
    assert sum(ranks(graph.iterate(pages, 3)).values()) == pytest.approx(1)
    assert ranks(graph.pagerank(pages.limit(0))) == {}


def test_popularity(spark):
    pages = spark.createDataFrame([("A",), ("Z",)], "url string")
    got = graph.with_popularity(pages, spark.createDataFrame([("A", 0.5)], "url string, pr double"))
    assert {r.url: r.popularity for r in got.collect()} == {"A": 0.5, "Z": 0.0}
    assert graph.report(spark.createDataFrame([("A", 0.5)], "url string, pr double")).first().pages == 1


ROBOTS = """# file
User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /private
Crawl-delay: 3
Crawl-delay: x
User-agent: Other
Disallow: /
user-agent: MyWebCrawler/1.0
DISALLOW: /mine
Disallow:
"""


def test_robots(spark):
    rules = crawl.robots_rules(spark.createDataFrame([("http://a.com", ROBOTS)], "key string, text string"))
    assert {(r.prefix, r.allow) for r in rules.collect()} == {("/private", False), ("/private/open", True), ("/mine", False)}
    assert {r.delay for r in rules.collect()} == {3000}
    urls = ["http://a.com/private/x", "http://a.com/private/open/x", "http://a.com/mine", "http://a.com/other", "http://b.com/private", "http://a.com"]
    got = crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert {r.url: r.allowed for r in got.collect()} == dict(zip(urls, [False, True, False, True, True, True], strict=True))


def test_seeds_and_frontier(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("News\nhttps://b.com/1\n\n# no\nhttps://a.com/1\nhttps://a.com/2\nnot a url\nhttps://b.com/2\n")
    seeds = files.read_seeds(spark, str(tmp_path / "seeds.txt"))
    assert [r.url for r in crawl.frontier_order(seeds).collect()] == ["https://a.com/1", "https://b.com/1", "https://a.com/2", "https://b.com/2"]


def test_admission_stops_at_the_limit_after_filters(spark):
    links = [(1, i, f"http://a.com/{i}") for i in range(50)] + [(1, 50, "http://A.com/1"), (2, 0, "http://a.com/3"), (2, 1, "mailto:x@y.z"), (2, 2, "http://new.com/")]
    visited = spark.createDataFrame([("http://a.com/0",)], "url string")
    got = crawl.admit(spark.createDataFrame(links, "page_id long, pos int, url string"), visited).collect()
    assert sorted(r.pos for r in got if r.page_id == 1) == list(range(1, 36))
    assert [r.url for r in got if r.page_id == 2] == ["http://new.com/"]


def test_response_average_is_cut_at_each_step(spark):
    rows = [("a", 1, 1, 101.9), ("a", 2, 2, 55.0), ("a", 3, 3, 999.0), ("b", 1, 1, 7.0)]
    got = crawl.response_averages(spark.createDataFrame(rows, "domain string, at long, seq long, ms double")).collect()
    a = int(0.7 * int(0.7 * 101 + 0.3 * 55) + 0.3 * 999)
    assert {r.domain: (r.average, r.successes) for r in got} == {"a": (a, 3), "b": (7, 1)}


def test_adaptive_delay(spark):
    df = spark.createDataFrame([(400, 6), (400, 5), (600, 9), (3000, 9)], "a int, s long")
    assert [r[0] for r in df.select(crawl.adaptive_delay(F.col("a"), F.col("s"))).collect()] == [200, 500, 500, 500]


def test_summary(spark):
    df = spark.createDataFrame([(True, True, True, False), (False, True, True, False), (True, False, True, True), (True, True, True, True)], "a boolean, f boolean, h boolean, d boolean")
    row = crawl.summary(df.select(crawl.outcome(F.col("a"), F.col("f"), F.col("h"), F.col("d")).alias("outcome"))).first()
    assert (row.attempted, row.saved, row.skipped, row.robots, row.fetch, row.duplicate) == (4, 1, 3, 1, 1, 1)


def test_crawl_round(spark):
    store = spark.createDataFrame([(1, "http://a.com/1", '<a href="/2">x</a><a href="http://b.com/">y</a><a href="/1">z</a>')], "page_id long, url string, html string")
    frontier = spark.createDataFrame([(0, "http://a.com/1", "a.com"), (1, "http://a.com/no", "a.com")], "seq long, url string, domain string")
    rules = crawl.robots_rules(spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /no")], "key string, text string"))
    pages, following = crawl.crawl_round(frontier, spark.createDataFrame([], "url string"), store, rules)
    assert [r.url for r in pages.collect()] == ["http://a.com/1"]
    assert sorted(r.url for r in following.collect()) == ["http://a.com/2", "http://b.com/"]


def test_file_sources(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The\n\n and \nthe\n")
    assert sorted(r.word for r in files.read_words(spark, str(tmp_path / "stop.txt")).collect()) == ["and", "the"]
    (tmp_path / "robots.txt").write_text("User-agent: *\nDisallow: /x\n")
    assert files.read_robots(spark, str(tmp_path / "robots.txt")).first().text.count("\n") == 2
    pages = spark.createDataFrame([(1, "a")], "id long, url string")
    for _ in range(2):
        files.append_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 2
    out = files.to_json(spark.createDataFrame([(1, 0.5)], "doc_id long, score double")).first().json
    assert json.loads(out) == {"docId": 1, "score": 0.5}


def test_streamed_index(spark, tmp_path):
    source = str(tmp_path / "in")
    page = lambda i, t: (i, f"http://a.com/{i}", f"<html><body><p>{t}</p></body></html>")
    kind = "page_id long, url string, html string"
    for batch in ([page(1, "java stack")], [page(2, "java"), page(1, "changed words")]):
        spark.createDataFrame(batch, kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        incremental.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    got = incremental.load(spark, str(tmp_path / "ix"))
    assert {(r.word, r.doc_id) for r in got.postings.collect()} == {("java", 2), ("chang", 1), ("word", 1)}


def test_streamed_averages_equal_the_fold(spark, tmp_path):
    rows = [("a", 1, 1, 101.9), ("a", 2, 2, 55.0), ("a", 3, 3, 999.0), ("b", 1, 1, 7.0)]
    kind = "domain string, at long, seq long, ms double"
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, kind).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.averages(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        keep = lambda df, n, k=k: df.write.mode("overwrite").parquet(str(tmp_path / f"out{k}"))
        q.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.domain: (r.average, r.successes) for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    expected = {r.domain: (r.average, r.successes) for r in crawl.response_averages(spark.createDataFrame(rows, kind)).collect()}
    assert got == expected


def test_part_graph(spark):
    lines = [(1, 1, 5, 1, 1.0, "R"), (1, 2, 6, 1, 1.0, "R"), (1, 3, 7, 1, 1.0, "N"), (1, 4, 5, 1, 1.0, "R")]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string")
    pages = graph.part_follow_pages(spark, lineitem, spark.createDataFrame([(5,), (6,), (7,)], "p_partkey long"))
    assert {r.url: r.links for r in pages.collect()} == {"5": ["6"], "6": ["5"], "7": None}


def test_priority(spark):
    links = [(1, "http://a/"), (1, "http://a/"), (2, "http://a/"), (2, "http://b/"), (1, "http://c/")]
    got = crawl.by_priority(spark.createDataFrame(links, "page_id long, url string")).collect()
    assert [(r.url, r.link_score) for r in got] == [("http://a/", 2), ("http://b/", 1), ("http://c/", 1)]


def test_a_busy_domain_waits_and_takes_turns(spark):
    rows = [("busy", 100 * i, i) for i in range(3000)] + [("calm", 0, 1), ("calm", 10_000, 2), (None, 5, 9)]
    df = spark.createDataFrame(rows, "domain string, ms long, seq long").withColumn("at", F.timestamp_millis("ms"))
    got = {(r.domain, r.seq): r.wait for r in crawl.access_wait(df).collect()}
    assert len(got) == len(rows) and got["busy", 0] == got["calm", 1] == got["calm", 2] == got[None, 9] == 0
    assert all(got["busy", i] == 400 for i in range(1, 3000))
    turns = crawl.frontier_order(df.select("seq", F.col("seq").cast("string").alias("url"), "domain")).collect()
    assert {(r.domain, r.seq): r.turn for r in turns} == {**{("busy", i): i + 1 for i in range(3000)}, ("calm", 1): 1, ("calm", 2): 2, (None, 9): 1}


def test_a_round_fetches_a_url_once(spark):
    store = spark.createDataFrame([(1, "http://a.com/1", "x"), (2, "http://a.com/2", "y")], "page_id long, url string, html string")
    frontier = spark.createDataFrame([(k, f"http://a.com/{1 + k % 2}", "a.com") for k in range(10)], "seq long, url string, domain string")
    rules = crawl.robots_rules(spark.createDataFrame([], "key string, text string"))
    pages, _ = crawl.crawl_round(frontier, spark.createDataFrame([], "url string"), store, rules, 5)
    assert sorted(r.page_id for r in pages.collect()) == [1, 2]


def test_waits_equal_the_sql_on_odd_times(spark, tmp_path):
    """Parts of milliseconds, times before 1970, clocks put forward, and unknown times and numbers beside equal ones."""
    times = ["1964-02-03 04:05:06.0001", "1964-02-03 04:05:06.100999", "2024-01-01 00:00:00.0005", "2024-01-01 00:00:00.1004", "2024-01-01 00:00:00.2996", "2024-03-31 02:59:59.9", "2024-03-31 03:00:00.1", "2024-05-01 00:00:00", "2024-05-01 00:00:00", None, None]
    rows = [(7, t, None if k == 7 else k, "view", 1.0) for k, t in enumerate(times)]
    odd = spark.createDataFrame(rows, "user_id long, ts string, event_id long, event_type string, value double")
    odd.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        expected = rows_of_duckdb(c, registry.oracle_sql()["access_wait"])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert rows_of_spark(registry.queries()["access_wait"](spark, str(tmp_path))) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
