"""Queries over an index: bags of words, conjunctions, phrases and their combinations; ranking, previews and paging.

A query's plan is lazy: candidates are rows (doc_id, term, tf, in_title, idf, qtf, importance), whose weighted sum is the
relevance. Postings are filtered by literal words, which reaches the Parquet scan. Snippets are read for ranked documents
only, after the limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.stem import stem_word
from ..plans.parser import Bag, Both, Phrase, Query, parse, words_of
from .index import Index

#: Shares of relevance and popularity in a score, the boost of a word in the title, hits of a page; fixed values.
RELEVANCE, POPULARITY, TITLE, PAGE = 0.7, 0.3, 2.0, 10
TERM = "doc_id, term, tf, in_title, idf, qtf, importance".split(", ")
#: Importance of a phrase is 1, and this for each time that it occurs; a fixed value.
PER_PHRASE = 0.1


def stem_words(words: tuple[str, ...], stemmed: bool = True) -> list[str]:
    """The query's words as the index has them."""
    return [s for w in words if (s := stem_word(w))] if stemmed else list(words)


def term_candidates(index: Index, words: list[str]) -> DataFrame:
    """Documents with any of the words; a word asked for k times counts k times. Unknown words are skipped."""
    times = Counter(words)
    qtf = F.lit(0)
    for w, n in sorted(times.items()):
        qtf = F.when(F.col("word") == w, n).otherwise(qtf)
    hits = index.postings.where(F.col("word").isin(sorted(times))).select("word", "doc_id", "tf", "in_title", F.col("importance_score").alias("importance"))
    idf = index.dictionary.where(F.col("word").isin(sorted(times))).select("word", "idf")
    return hits.join(F.broadcast(idf), "word", "left").withColumn("qtf", qtf).withColumnRenamed("word", "term").select(TERM)


def conjunctive(index: Index, words: list[str]) -> DataFrame:
    """(doc_id): documents that have all of the words."""
    distinct = sorted(set(words))
    hits = index.postings.where(F.col("word").isin(distinct)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(distinct)).select("doc_id")


def back(n: int) -> Callable[[Column], Column]:
    return lambda p: p - n


def phrase_hits(index: Index, words: list[str]) -> DataFrame:
    """(doc_id, count, length, in_title): exact phrases, by the positions p of the first word with word i at p + i for
    all i. in_title: one starts and ends in the title, whose positions are the first."""
    at = index.postings.where(F.col("word").isin(sorted(set(words)))).select("word", "doc_id", "positions", "length", "title_length")
    rows = [at.where(F.col("word") == w).withColumn(f"p{i}", F.transform("positions", back(i))).drop("word", "positions") for i, w in enumerate(words)]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r.drop("length", "title_length"), "doc_id")
    starts = F.col("p0")
    for i in range(1, len(words)):
        starts = F.array_intersect(starts, F.col(f"p{i}"))
    out = out.withColumn("starts", starts).where(F.size("starts") > 0)
    titled = F.array_min("starts") + len(words) <= F.col("title_length")
    return out.select("doc_id", F.size("starts").alias("count"), "length", titled.alias("in_title"))


def phrase_candidates(index: Index, words: list[str], phrase_tf: str = "length") -> DataFrame:
    """A phrase is a term of its own: tf = count / length, idf from the number of hits. Its single words add nothing.
    phrase_tf="zero" sets tf to 0, so that popularity alone ranks."""
    hits = phrase_hits(index, words)
    found = hits.agg(F.count(F.lit(1)).alias("found"))
    n = index.dictionary.select("n_docs").limit(1)
    idf = F.log(F.col("n_docs") / (1 + F.col("found")))
    tf = F.lit(0.0) if phrase_tf == "zero" else F.when(F.col("length") == 0, 0.0).otherwise(F.col("count") / F.col("length"))
    out = hits.join(F.broadcast(found)).join(F.broadcast(n))
    importance = 1 + PER_PHRASE * F.col("count")
    return out.select("doc_id", F.lit(" ".join(words)).alias("term"), tf.alias("tf"), "in_title", idf.alias("idf"), F.lit(1).alias("qtf"), importance.alias("importance"))


def combine(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates of both sides for AND, either for OR, left without right for NOT.

    Terms of a document are united; of a term on both sides the row with the higher tf stays (the left one if equal),
    and it counts as often as both sides ask for it.
    """
    if kind == "NOT":
        return left.join(right.select("doc_id").distinct(), "doc_id", "left_anti")
    if kind == "AND":
        ids = left.select("doc_id").distinct().join(right.select("doc_id").distinct(), "doc_id", "left_semi")
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)))
    if kind == "AND":
        both = both.join(ids, "doc_id", "left_semi")
    best = F.max_by(F.struct("tf", "in_title", "idf", "importance"), F.struct("tf", "side"))
    merged = both.groupBy("doc_id", "term").agg(best.alias("b"), F.sum("qtf").cast("int").alias("qtf"))
    return merged.select("doc_id", "term", "b.tf", "b.in_title", "b.idf", "qtf", "b.importance")


def candidates(index: Index, q: Query, stemmed: bool = True, phrase_tf: str = "length") -> DataFrame:
    if isinstance(q, Both):
        return combine(q.kind, candidates(index, q.left, stemmed, phrase_tf), candidates(index, q.right, stemmed, phrase_tf))
    words = stem_words(q.words, stemmed)
    if isinstance(q, Phrase) and len(words) > 1:
        return phrase_candidates(index, words, phrase_tf)
    return term_candidates(index, words)


def rank(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, relevance, popularity, score, url, title, publish_date, terms), best first; equal scores by doc_id. terms
    are the query's terms that the document has.

    relevance = sum of qtf * tf * idf, doubled for words in the title; score = 0.7 relevance + 0.3 popularity.
    """
    part = F.col("qtf") * F.col("tf") * F.coalesce("idf", F.lit(0.0)) * F.when(F.col("in_title"), TITLE).otherwise(1.0)
    relevance = found.groupBy("doc_id").agg(F.sum(part).alias("relevance"), F.array_sort(F.collect_set("term")).alias("terms"))
    date = text.publish_date(F.col("timestamp")) if "timestamp" in docs.columns else F.lit("")
    known = docs.select("doc_id", "url", "title", F.coalesce("popularity", F.lit(0.0)).alias("popularity"), date.alias("publish_date"))
    score = RELEVANCE * F.col("relevance") + POPULARITY * F.col("popularity")
    out = relevance.join(known, "doc_id").withColumn("score", score)
    return out.select("doc_id", "relevance", "popularity", "score", "url", "title", "publish_date", "terms").orderBy(F.desc("score"), "doc_id")


def matches(q: Query, stemmed: bool) -> Column:
    """Whether a document whose terms are known meets q."""
    if isinstance(q, Both):
        left, right = matches(q.left, stemmed), matches(q.right, stemmed)
        return {"AND": left & right, "OR": left | right, "NOT": left}[q.kind]
    words = stem_words(q.words, stemmed)
    if isinstance(q, Phrase) and len(words) > 1:
        return F.array_contains("terms", " ".join(words))
    return F.exists("terms", lambda t: t.isin(words))


def preview(q: Query, stemmed: bool) -> Column:
    """The snippet to show, of a document's snippets by word (shown): the left side's of a combination if the document
    meets it; the first matching word's best for a bag; one that the phrase's words share for a phrase."""
    if isinstance(q, Both):
        left, right = preview(q.left, stemmed), preview(q.right, stemmed)
        return F.when(matches(q.left, stemmed), left).otherwise(right) if q.kind == "OR" else left
    words = stem_words(q.words, stemmed)
    if isinstance(q, Phrase) and len(words) > 1:
        return text.phrase_snippet([F.col("shown")[w] for w in words], words)
    out = F.lit(text.NO_PREVIEW)
    for w in reversed(words):
        out = F.when(F.col("shown")[w].isNotNull(), text.best_snippet(F.col("shown")[w], F.lit(w))).otherwise(out)
    return out


def with_previews(index: Index, ranked: DataFrame, q: Query, stemmed: bool = True) -> DataFrame:
    """ranked with snippet, in which all of the query's words are marked as they were asked for."""
    words = sorted(set(stem_words(words_of(q), stemmed)))
    hits = index.postings.where(F.col("word").isin(words)).select("doc_id", "word", "snippets")
    hits = hits.join(ranked.select("doc_id"), "doc_id", "left_semi")
    shown = hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "snippets"))).alias("shown"))
    snippet = text.highlight(F.coalesce(preview(q, stemmed), F.lit(text.NO_PREVIEW)), list(words_of(q)))
    return ranked.join(shown, "doc_id", "left").withColumn("snippet", snippet).drop("shown").orderBy(F.desc("score"), "doc_id")


def search(index: Index, query: str, limit: int | None = None, stemmed: bool = True, phrase_tf: str = "length", previews: bool = True) -> DataFrame:
    """Ranked documents of a query; an empty query, or one of unknown words, has none. With previews (of an index that has
    snippets) also a snippet."""
    q = parse(query)
    out = rank(candidates(index, q, stemmed, phrase_tf), index.docs)
    out = out if limit is None else out.limit(limit)
    return with_previews(index, out, q, stemmed) if previews and "snippets" in index.postings.columns else out


def page(ranked: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page number (from 1) of ranked results with their rank and the number of pages. Only the pages up to it are sorted out."""
    pages = ranked.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("pages"))
    top = ranked.orderBy(F.desc("score"), "doc_id").limit(number * size)
    ranked_top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")))
    return ranked_top.where(F.col("rank") > (number - 1) * size).join(F.broadcast(pages))


def query_terms(q: Query, stemmed: bool = True) -> list[str]:
    """The terms of a query, a phrase as one, left before right and each once."""
    if isinstance(q, Both):
        return list(dict.fromkeys(query_terms(q.left, stemmed) + query_terms(q.right, stemmed)))
    words = stem_words(q.words, stemmed)
    return [" ".join(words)] if isinstance(q, Phrase) and len(words) > 1 else list(dict.fromkeys(words))


def query_input(index: Index, query: str, stemmed: bool = True, phrase_tf: str = "length") -> DataFrame:
    """(doc_id, json): what ranking a candidate document takes, in the key names of the ranking service: query_terms,
    candidate_documents (the row's one), and global_stats, the same in every row.

    global_stats counts the words of the query and its phrases, whose idf and number of documents come from their hits.
    """
    q = parse(query)
    found, words = candidates(index, q, stemmed, phrase_tf), sorted(set(stem_words(words_of(q), stemmed)))
    stats = F.struct("tf", "in_title", F.col("importance").alias("importance_score"))
    each = found.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", stats.alias("s"))))).alias("term_stats"))
    each = each.join(index.docs, "doc_id").withColumns({"terms": F.map_keys("term_stats"), "score": F.lit(0.0)})
    each = with_previews(index, each, q, stemmed) if "snippets" in index.postings.columns else each.withColumn("snippet", F.lit(None).cast("string"))
    meta = F.struct("popularity", "length", text.publish_date(F.col("timestamp")).alias("publish_date"), F.col("url").alias("URL"), "title", "snippet")
    n = index.dictionary.select("n_docs").limit(1)
    counted = index.dictionary.where(F.col("word").isin(words)).select("word", F.col("doc_count").cast("long").alias("n"), "idf")
    for term in query_terms(q, stemmed):
        if " " in term:
            hits = phrase_hits(index, term.split(" ")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n))
            counted = counted.union(hits.select(F.lit(term), "n", F.log(F.col("n_docs") / (1 + F.col("n")))))
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", c))))
    known = counted.agg(of("n").alias("docs_containing_term"), of("idf").alias("term_idf")).join(F.broadcast(n))
    stats = F.struct(F.col("n_docs").alias("total_docs"), "docs_containing_term", "term_idf")
    one = F.create_map(F.col("doc_id").cast("string"), F.struct("term_stats", meta.alias("metadata")))
    asked = F.array(*[F.lit(t) for t in query_terms(q, stemmed)]).cast("array<string>")
    whole = F.struct(asked.alias("query_terms"), one.alias("candidate_documents"), stats.alias("global_stats"))
    return each.join(F.broadcast(known)).select("doc_id", F.to_json(whole).alias("json"))
