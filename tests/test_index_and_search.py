"""Index building, queries, ranking and maintenance on small hand-made documents and by brute force."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import index, maintain, search
from lexiforge.plans.parser import Bag, Both, Phrase, analyse, parse

DOCS = [
    (1, "Java stack traces, java stacks and the Java stack"),
    (2, "The stack of plates; a new york minute"),
    (3, "new roads, york city and new york"),
    (4, "of the and a"),
    (5, None),
    (6, "yorks new. New York new york"),
]


@pytest.fixture(scope="module")
def ix(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return index.build(index.fields_of_documents(docs))


def test_postings(spark, ix):
    rows = {(r.word, r.doc_id): r for r in ix.postings.collect()}
    r = rows["java", 1]
    assert (r.frequency, r.length, r.positions, r.in_title, r.importance_score) == (3, 7, [0, 3, 5], False, 3.0)
    assert r.tf == 3 / 7
    assert {d for _, d in rows} == {1, 2, 3, 6}  # documents without kept tokens have none


def test_properties(ix):
    by_doc = {}
    for r in ix.postings.collect():
        assert len(r.positions) == r.frequency
        by_doc.setdefault(r.doc_id, []).append(r)
    for rows in by_doc.values():
        assert sum(r.frequency for r in rows) == rows[0].length
        assert sorted(p for r in rows for p in r.positions) == list(range(rows[0].length))


def test_idf(ix):
    idf = {r.word: r.idf for r in ix.dictionary.collect()}
    assert idf["york"] == pytest.approx(math.log(4 / 4))
    assert idf["java"] == pytest.approx(math.log(4 / 2))


def test_idf_golden_values():
    assert [math.log(10 / (1 + df)) for df in (2, 3, 5)] == pytest.approx([1.2039728043259361, 0.9162907318741551, 0.5108256237659907])


def test_fields_and_weights(spark):
    page = "<html><head><title>Java</title></head><body><h2>Second java</h2><h1>First</h1><p>java body</p></body></html>"
    fields = index.fields_of_pages(spark.createDataFrame([(1, "http://a.com", page)], "page_id long, url string, html string"))
    at = {r.position: (r.token, r.field) for r in index.occurrences(fields).collect()}
    assert [at[i] for i in range(4)] == [("java", "title"), ("first", "header"), ("second", "header"), ("java", "header")]
    row = index.postings(fields).where("word = 'java'").first()
    assert (row.importance_score, row.in_title, row.frequency, row.title_length) == (3 + 2 + 1 + 1, True, 4, 1)


def test_parse():
    assert parse("the java AND stack") == Bag(("java", "stack"))
    assert parse('"new york"') == Phrase(("new", "york"))
    assert parse('"new york') == Phrase(("new", "york"))
    assert parse('"york"') == Bag(("york",))
    assert parse('"') == Bag(())
    assert parse('"new york" AND "java" NOT "x y"') == Both("NOT", Both("AND", Phrase(("new", "york")), Bag(("java",))), Bag(()))
    assert analyse("café Cafe don't") == ("cafe",)


def hits(ix, q):
    return {r.doc_id for r in search.search(ix, q).collect()}


def test_queries(ix):
    assert hits(ix, "java york") == {1, 2, 3, 6}
    assert hits(ix, '"new york"') == {2, 3, 6}
    assert hits(ix, '"york new"') == {6}
    assert hits(ix, '"new york" NOT "stack plates"') == {3, 6}
    assert hits(ix, '"new york" AND "stack plates"') == {2}
    assert hits(ix, '"java stack" OR "stack plates"') == {1, 2}
    assert hits(ix, '"new york" AND "absent words"') == set()
    assert hits(ix, '"absent words" OR "new york"') == {2, 3, 6}
    assert hits(ix, "") == hits(ix, "unknownword") == set()
    assert {r.doc_id for r in search.conjunctive(ix, ["new", "road"]).collect()} == {3}


def test_N1_phrase_tf(ix):
    row = search.candidates(ix, parse('"new york"')).where("doc_id = 6").first()
    assert row.tf == pytest.approx(2 / 6) and row.idf == pytest.approx(math.log(4 / 4))
    zero = search.candidates(ix, parse('"new york"'), phrase_tf="zero").where("doc_id = 6").first()
    assert zero.tf == 0


def test_overlapping_phrase(spark):
    docs = spark.createDataFrame([(1, "ha ha ha")], "doc_id long, text string")
    row = search.phrase_hits(index.build(index.fields_of_documents(docs)), ["ha", "ha"]).first()
    assert row["count"] == 2


def test_repeated_terms_count_repeatedly(ix):
    once, twice = (search.search(ix, q).where("doc_id = 1").first().relevance for q in ("java", "java java"))
    assert twice == pytest.approx(2 * once)


def test_N18_phrase_in_title(spark):
    docs = spark.createDataFrame([(1, "News of New York", "x"), (2, "New", "york x"), (3, "other", "new york")], "doc_id long, t string, text string")
    fields = index.fields_of_documents(docs, F.col("t"))
    got = {r.doc_id: r.in_title for r in search.phrase_hits(index.build(fields), ["new", "york"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_golden_ranking(spark):
    """A captured ranking: relevance to score with popularity 0.5; and a title boost on given idf."""
    rows = [("doc_1", 0.030982209325413488, 0.17168754652778945), ("doc_4", 0.02529134994546149, 0.16770396494182303)]
    for _, relevance, score in rows:
        assert search.RELEVANCE * relevance + search.POPULARITY * 0.5 == pytest.approx(score, rel=1e-6)
    found = spark.createDataFrame([(1, "a", 0.05, True, 0.45, 1), (1, "b", 0.03, False, 0.55, 1)], "doc_id long, term string, tf double, in_title boolean, idf double, qtf int")
    docs = spark.createDataFrame([(1, "", "", 0.85)], "doc_id long, url string, title string, popularity double")
    row = search.rank(found, docs).first()
    assert row.relevance == pytest.approx(0.0615) and row.score == pytest.approx(0.29805)


def test_paging_and_limit(spark, ix):
    ranked = search.search(ix, "java new york stack")
    assert search.page(ranked, 1, 3).count() == 3
    assert [(r["rank"], r.pages) for r in search.page(ranked, 2, 3).collect()] == [(4, 2)]
    assert search.search(ix, "java new york stack", 2).count() == 2


def test_json(ix):
    assert search.query_input(ix, "java").count() == 1


def test_forward_and_nested(ix):
    words = {r.doc_id: r.words for r in index.forward(ix.postings).collect()}
    assert words[2] == sorted({"stack", "plate", "new", "york", "minut"})
    assert index.nested(ix.postings, ix.dictionary).where("word = 'york'").first().doc_count == 3


def test_numbers_survive_merged_partitions(spark):
    """Many ranges, of which adaptive plans make few: every row keeps its number, whoever reads it."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for k, v in zip(old, ("64", "1m", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        table = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("x"), (F.col("id") % 3 > 0).alias("g"), F.lit("y" * 20).alias("y"))
        out = maintain.number(maintain.number(table, ["x"]), ["x"], "m", ["g"])
        row = out.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_if(F.col("n") != F.col("x") + 1)).first()
        assert tuple(row) == (400_000, 400_000, 1, 400_000, 0)
        for r in out.groupBy("g").agg(F.count("*").alias("c"), F.count_distinct("m").alias("d"), F.max("m").alias("m")).collect():
            assert r.c == r.d == r.m
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shown(ix, q):
    return {r.doc_id: r.snippet for r in search.search(ix, q).collect()}


def test_previews(spark, ix):
    assert shown(ix, "york")[2] == "The stack of plates; a new <strong><strong>york</strong></strong> minute"
    first = shown(ix, "minute stack")  # of the first word that the document has, all words marked
    assert first[2].count("<strong>") == 3 and "<strong><strong>minute</strong></strong>" not in first[1]
    assert shown(ix, '"new york"')[3].startswith("<strong>")
    either = shown(ix, '"stack plates" OR "new york"')
    assert set(either) == {2, 3, 6} and "<strong>stack</strong>" in either[2]
    assert shown(ix, '"new york" NOT "stack plates"').keys() == {3, 6}
    bare = index.build(index.fields_of_documents(spark.createDataFrame(DOCS, "doc_id long, text string")), shown=False)
    assert "snippet" not in search.search(bare, "york").columns


def test_dates_and_metadata(spark):
    docs = spark.createDataFrame([(1, "java stack", 1704067200000), (2, "java", None)], "doc_id long, text string, timestamp long")
    ix = index.build(index.fields_of_documents(docs))
    assert {r.doc_id: r.publish_date for r in search.search(ix, "java").collect()} == {1: "2024-01-01", 2: ""}
    row = index.nested(ix.postings, ix.dictionary, ix.docs).where("word = 'java'").first()
    assert [(p.doc_id, p.timestamp, p.popularity, p.snippets) for p in row.postings] == [(1, 1704067200000, 0.0, ["<strong>java</strong> stack"]), (2, None, 0.0, ["<strong>java</strong>"])]


def test_query_input(ix):
    got = {r.doc_id: json.loads(r.json) for r in search.query_input(ix, '"new york" OR "stack plates"').collect()}
    assert set(got) == {2, 3, 6}
    six = got[6]["candidate_documents"]["6"]["term_stats"]["new york"]
    assert six["importance_score"] == pytest.approx(1.2) and six["tf"] == pytest.approx(2 / 6)
    stats = got[2]["global_stats"]
    assert got[2]["query_terms"] == ["new york", "stack plate"]
    assert stats["total_docs"] == 4 and stats["docs_containing_term"] == {"new": 3, "york": 3, "stack": 2, "plate": 1, "new york": 3, "stack plate": 1}
    assert stats["term_idf"]["stack plate"] == pytest.approx(math.log(4 / 2))


def test_one_pass_equals_grouping(spark, ix):
    """Postings of the one pass against grouped occurrences, whose stems are made by expressions."""
    fields = index.fields_of_documents(spark.createDataFrame(DOCS, "doc_id long, text string"))
    at = index.occurrences(fields).join(index.stems(index.occurrences(fields)), "token")
    want = {(r.word, r.doc_id): sorted(r.p) for r in at.groupBy("word", "doc_id").agg(F.collect_list("position").alias("p")).collect()}
    assert {(r.word, r.doc_id): r.positions for r in ix.postings.collect()} == want


def test_save_and_load(spark, ix, tmp_path):
    ix.save(str(tmp_path / "ix"))
    again = index.Index.load(spark, str(tmp_path / "ix"))
    assert hits(again, "java") == {1}


def test_order_of_rows_does_not_matter(spark, ix):
    docs = spark.createDataFrame(DOCS[::-1], "doc_id long, text string").repartition(3)
    again = index.build(index.fields_of_documents(docs))
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, ix.postings.collect()))


def test_replace_equals_rebuilding(spark, ix):
    changed = spark.createDataFrame([(2, "completely new words"), (7, "java")], "doc_id long, text string")
    known = maintain.to_clean(changed, index.forward(ix.postings))
    assert [r.doc_id for r in known.collect()] == [2]
    assert {r.word for r in maintain.affected_words(known, index.forward(ix.postings)).collect()} == {"stack", "plate", "new", "york", "minut"}
    new = index.postings(index.fields_of_documents(changed), shown=True)
    _, words = maintain.replace(ix.postings, changed, new)
    docs = spark.createDataFrame([d for d in DOCS if d[0] != 2], "doc_id long, text string").union(changed)
    rebuilt = index.dictionary(index.postings(index.fields_of_documents(docs)))
    assert sorted(map(str, words.collect())) == sorted(map(str, rebuilt.collect()))
    assert words.where("word = 'plate'").isEmpty()  # nothing uses it any more


def test_deduplicate(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in maintain.deduplicate(docs, "text", ["doc_id"]).collect()) == [1, 2]


def test_unindexed(spark):
    pages = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, None), (4, "d", None)], "id long, url string, indexed boolean")
    todo, rejected = maintain.unindexed(pages, ["url"])
    assert (sorted(r.id for r in todo.collect()), [r.id for r in rejected.collect()]) == ([2, 4], [3])
    assert maintain.unindexed(pages.drop("indexed"), ["url"])[0].count() == 3


def test_upsert_set_field_number(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    change = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted((r.id, r.v) for r in maintain.upsert(table, change, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.id, r.v) for r in maintain.set_field(table, change, "id", "v").collect()) == [(1, "a"), (2, "c")]
    numbered = maintain.number(spark.range(100).withColumnRenamed("id", "x"), ["x"])
    assert sorted((r.x, r.n) for r in numbered.collect()) == [(i, i + 1) for i in range(100)]
    assert maintain.highest(table, "id").first().id == 2
