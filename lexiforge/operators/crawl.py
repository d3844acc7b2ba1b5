"""The dataflow side of crawl control: frontier order, link admission, robots rules, rate limits, counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType
from pyspark.sql.window import Window

from ..functions import html, urls
from ..session import written
from . import maintain

#: The crawler's name in robots files, links admitted of a page, pages of a crawl.
AGENT, MOST_LINKS, MOST_PAGES = "MyWebCrawler/1.0", 35, 700
#: Fixed values in milliseconds and successes: usual, fast and longest delay, and when a domain counts as fast or slow.
DELAY, FAST_DELAY, LONGEST_DELAY, FAST_AFTER, FAST_BELOW, SLOW_ABOVE = 500, 200, 2000, 5, 500, 2000


def seeds(lines: DataFrame) -> DataFrame:
    """(seq, url, domain) of seed lines (seq, value); headings, blanks and comments do not parse and drop out."""
    out = lines.withColumn("url", urls.normalize(F.col("value"))).where("url is not null")
    return out.select("seq", "url", urls.domain(F.col("url")).alias("domain"))


def frontier_order(frontier: DataFrame) -> DataFrame:
    """frontier (seq, url, domain) with turn: domains take turns in alphabetical order, each in its own order of seq."""
    return maintain.number(frontier, ["seq", "url"], "turn", ["domain"]).withColumn("turn", F.col("turn").cast("int")).orderBy("turn", "domain")


def by_priority(links: DataFrame) -> DataFrame:
    """(url, link_score) of links (page_id, url): a target's score is the number of pages that link to it, the highest
    come first, equals by url."""
    scores = links.select("page_id", "url").distinct().groupBy("url").agg(F.count(F.lit(1)).alias("link_score"))
    return scores.orderBy(F.desc("link_score"), "url")


def out_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, url) of pages (page_id, url, html): all links, made absolute, empty ones dropped."""
    each = pages.select("page_id", "url", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    return each.withColumn("link", urls.resolve(F.col("url"), F.col("href"))).where("link <> ''").select("page_id", "pos", "href", F.col("link").alias("url"))


def admit(links: DataFrame, visited: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(page_id, pos, url): of each page the first most links that are new: they normalise, are http, are not visited
    (url), and are not admitted from an earlier place (page_id, pos)."""
    new = links.withColumn("url", urls.normalize(F.col("url"))).where(F.col("url").isNotNull() & urls.is_http(F.col("url")))
    new = new.groupBy("url").agg(F.min(F.struct("page_id", "pos")).alias("at")).join(visited.select("url"), "url", "left_anti")
    new = new.select("at.page_id", "at.pos", "url")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return new.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def robots_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """(key, prefix, allow, delay) of robots files (key, text): rules of the groups for * or for the agent.

    A user-agent line replaces the one before it; of repeated prefixes the last counts; an empty Disallow says nothing.
    delay is the file's crawl delay in milliseconds (the last readable one), or null.
    """
    lines = files.select("key", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[\r\t]", " ")))
    low = F.lower("line")
    value = lambda k: F.trim(F.substring(F.col("line"), len(k) + 1, 1 << 30))
    who = F.last(F.when(low.startswith("user-agent:"), value("user-agent:")), ignorenulls=True).over(Window.partitionBy("key").orderBy("n"))
    ours = lines.withColumn("agent", who).where(F.col("agent").isin("*", agent))
    kind = F.when(low.startswith("disallow:"), "disallow").when(low.startswith("allow:"), "allow").when(low.startswith("crawl-delay:"), "delay")
    read = F.when(kind == "disallow", value("disallow:")).when(kind == "allow", value("allow:")).when(kind == "delay", value("crawl-delay:"))
    ours = ours.withColumns({"kind": kind, "value": read}).where("kind is not null")
    delays = ours.where("kind = 'delay'").withColumn("ms", F.expr("try_cast(value as bigint)") * 1000).where("ms is not null")
    delays = delays.groupBy("key").agg(F.max_by("ms", "n").alias("delay"))
    rules = ours.where("kind <> 'delay' and value <> ''").groupBy("key", F.col("value").alias("prefix")).agg((F.max_by("kind", "n") == "allow").alias("allow"))
    return rules.join(delays, "key", "full")


def robots_allowed(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates (url, ...) with allowed: by the longest rule that the path starts with; none, or no file: allowed.

    An equi join on the site, then a prefix test; each url comes back once.
    """
    at = candidates.withColumns({"key": urls.robots_key(F.col("url")), "path": urls.robots_path(F.col("url"))})
    distinct = at.select("url", "key", "path").distinct()
    fits = distinct.join(rules.where("prefix is not null").select("key", "prefix", "allow"), "key")
    fits = fits.where(F.col("path").startswith(F.col("prefix"))).groupBy("url").agg(F.max_by("allow", F.length("prefix")).alias("allow"))
    out = at.join(fits, "url", "left")
    return out.withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow", "key", "path")


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (domain, ms) in order, a domain's in one piece: (domain, average, successes) of each domain."""
    now, average, count, out = None, None, 0, []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["domain", "average", "successes"])

    kind = pa.null()
    for b in batches:
        kind = b.column(0).type
        for domain, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if count and domain != now:
                out.append((now, average, count))
                average, count = None, 0
            now, count = domain, count + 1
            average = int(ms) if average is None else int(average * 0.7 + ms * 0.3)
        if len(out) > 10_000:
            yield rows()
    if count:
        out.append((now, average, count))
    if out:
        yield rows()


def response_averages(responses: DataFrame) -> DataFrame:
    """(domain, average, successes) of responses (domain, at, seq, ms): the first time as it is, then
    int(0.7 average + 0.3 ms), cut at each step, in the order of at and seq.

    The cut makes each step depend on the one before, so a domain's responses pass one task in order, sorted and spilled
    by Spark and one at a time; none are held. Streams keep the average as state instead (streaming.averages).
    """
    spread = responses.select("domain", "at", "seq", "ms").where("ms is not null").repartition("domain").sortWithinPartitions("domain", "at", "seq")
    schema = StructType([spread.schema["domain"], StructField("average", IntegerType()), StructField("successes", LongType())])
    return spread.select("domain", F.col("ms").cast("double").alias("ms")).mapInArrow(fold, schema)


def adaptive_delay(average: Column, successes: Column) -> Column:
    """Milliseconds between requests to a domain."""
    fast = (successes > FAST_AFTER) & (average < FAST_BELOW)
    return F.when(fast, FAST_DELAY).when(average > SLOW_ABOVE, min(LONGEST_DELAY, DELAY)).otherwise(DELAY)


def epoch_millis(table: DataFrame, at: str) -> Column:
    """The nearest whole milliseconds from the epoch to a moment, halves away from it; a moment without time zone is taken
    as it stands, so that no change of the session's clocks comes between two of them."""
    if isinstance(table.schema[at].dataType, TimestampNTZType):
        passed = F.expr(f"cast(cast(`{at}` - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6))")
        micros = (passed * 1_000_000).cast("long")
    else:
        micros = F.unix_micros(F.col(at).cast("timestamp"))
    return F.call_function("div", F.round(micros, -3), F.lit(1000))


def access_wait(accesses: DataFrame, delay: int = DELAY) -> DataFrame:
    """accesses (domain, at, seq) with wait: milliseconds until delay has passed since the domain's access before.

    Accesses are numbered by domain, unknown times and numbers last, and each meets the one before by (domain, number),
    so that a busy domain is spread over tasks.
    """
    numbered = written(maintain.number(accesses, ["at", "seq"], "turn_", ["domain"]))
    numbered = numbered.withColumn("ms_", epoch_millis(numbered, "at"))
    before = numbered.select(F.col("domain").alias("domain_"), (F.col("turn_") + 1).alias("next_"), F.col("ms_").alias("before_"))
    both = numbered.join(before, F.col("domain").eqNullSafe(F.col("domain_")) & (F.col("turn_") == F.col("next_")), "left")
    wait = F.greatest(F.lit(0), F.coalesce(delay - (F.col("ms_") - F.col("before_")), F.lit(0))).cast("long")
    return both.withColumn("wait", wait).drop("turn_", "ms_", "domain_", "next_", "before_")


def outcome(allowed: Column, fetched: Column, is_html: Column, duplicate: Column) -> Column:
    """Why a page was not saved, or saved."""
    return F.when(~allowed, "robots").when(~fetched, "fetch").when(~is_html, "type").when(duplicate, "duplicate").otherwise("saved")


def summary(attempts: DataFrame) -> DataFrame:
    """One row of counters of attempts (outcome)."""
    count = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    skipped = F.count_if(F.col("outcome") != "saved").alias("skipped")
    return attempts.agg(F.count(F.lit(1)).alias("attempted"), count("saved"), skipped, count("robots"), count("fetch"), count("type"), count("duplicate"))


def latest(events: DataFrame, key: str, at: str, n: int = 10) -> DataFrame:
    """The n keys used last, each once, the latest first."""
    return events.groupBy(key).agg(F.max(at).alias("last")).orderBy(F.desc("last"), key).limit(n)


def crawl_round(frontier: DataFrame, visited: DataFrame, store: DataFrame, rules: DataFrame, most_pages: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(pages, next frontier) of one round: allowed and unvisited URLs, each once, in turn are looked up in the page store
    (page_id, url, html), and their links are admitted."""
    frontier = frontier.groupBy("url").agg(F.min("seq").alias("seq"), F.min("domain").alias("domain")).select("seq", "url", "domain")
    todo = robots_allowed(frontier.join(visited.select("url"), "url", "left_anti"), rules).where("allowed").drop("allowed")
    todo = frontier_order(todo).limit(most_pages)
    known = store.withColumn("key_", urls.normalize(F.col("url"))).where("key_ is not null")
    pages = todo.select("url").join(known.select(F.col("key_").alias("url"), "page_id", "html"), "url")
    seen = visited.select("url").union(frontier.select("url"))
    links = admit(out_links(pages), seen)
    return pages, links.select(F.monotonically_increasing_id().alias("seq"), "url", urls.domain(F.col("url")).alias("domain"))
