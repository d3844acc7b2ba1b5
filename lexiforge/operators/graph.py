"""PageRank over the links among known pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Damping, largest change at which ranks have converged, and iterations at most; fixed values.
DAMPING, EPSILON, MOST_ITERATIONS = 0.85, 1e-6, 100


def graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of pages (url, links array): nodes (url, out_degree), edges (src, dst) among known pages.

    A page's out-degree counts all of its links, repeats and unknown targets too; each known target is one edge. Null
    links count as none; of pages with one url one is kept.
    """
    pages = pages.where("url is not null").groupBy("url").agg(F.max(F.coalesce("links", F.array().cast("array<string>"))).alias("links"))
    nodes = pages.select("url", F.size("links").alias("out_degree"))
    edges = pages.select(F.col("url").alias("src"), F.explode(F.array_distinct("links")).alias("dst"))
    return nodes, edges.join(nodes.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")


def step(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One iteration: contributions along edges, the dangling pages' mass spread evenly, then normalised to sum 1."""
    now = nodes.join(ranks, "url")
    mass = now.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("pr"))), F.lit(0.0)).alias("mass"), F.count(F.lit(1)).alias("n"))
    part = now.where("out_degree > 0").select(F.col("url").alias("src"), (F.col("pr") / F.col("out_degree")).alias("part"))
    incoming = edges.join(part, "src").groupBy(F.col("dst").alias("url")).agg(F.sum("part").alias("incoming"))
    raw = nodes.select("url").join(incoming, "url", "left").join(F.broadcast(mass))
    value = (1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("incoming", F.lit(0.0)) + DAMPING * F.col("mass") / F.col("n")
    raw = raw.select("url", value.alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.join(F.broadcast(total)).select("url", (F.col("raw") / F.col("total")).alias("pr"))


def start(nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(F.broadcast(n)).select("url", (F.lit(1.0) / F.col("n")).alias("pr"))


def iterate(pages: DataFrame, iterations: int) -> DataFrame:
    """(url, pr) after a fixed number of iterations."""
    nodes, edges = (written(x) for x in graph(pages))
    ranks = written(start(nodes))
    for _ in range(iterations):
        # a step reads the ranks several times: unwritten, its plan would grow with their power
        ranks = written(step(nodes, edges, ranks))
    return ranks


def pagerank(pages: DataFrame, epsilon: float = EPSILON, most: int = MOST_ITERATIONS) -> DataFrame:
    """(url, pr) after convergence: no rank changes by more than epsilon, or most iterations are done.

    Each iteration is written once; the largest change, one number, is all that reaches the driver.
    """
    nodes, edges = (written(x) for x in graph(pages))
    ranks = written(start(nodes))
    for _ in range(most):
        after = written(step(nodes, edges, ranks))
        change = after.join(ranks.withColumnRenamed("pr", "old"), "url").agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
        ranks = after
        if change is None or change <= epsilon:
            break
    return ranks


def with_popularity(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """pages with popularity, 0 where a page has no rank."""
    out = pages.drop("popularity").join(ranks.select("url", F.col("pr").alias("popularity")), "url", "left")
    return out.withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))


def report(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count(F.lit(1)).alias("pages"), F.sum("pr").alias("total"), F.max("pr").alias("highest"))


def part_follow_pages(spark: SparkSession, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(url, links) of the part-follow graph: among returned lines of an order, each part links to the next one's."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = lineitem.where("l_returnflag = 'R'").select("l_partkey", F.lead("l_partkey").over(order).alias("next"))
    links = lines.where("next is not null").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(F.col("next").cast("string"))).alias("links"))
    return part.select("p_partkey").join(links, "p_partkey", "left").select(F.col("p_partkey").cast("string").alias("url"), "links")
