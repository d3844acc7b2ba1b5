"""The pipeline, stage by stage, against plain versions on its own inputs."""

import corpus_pipeline
import pytest
from compare import SMALL
from test_jaccard import plain_groups
from tokenizers import Tokenizer

from lexiforge.llm import langid, pii, queries


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, stages):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "pii", "source_mix", "bpe"]
    for df in stages[:-1]:
        assert df.dtypes == documents.dtypes


def test_language_keeps_clean_documents(spark, stages):
    before = rows(spark.read.parquet(f"{SMALL}/documents.parquet"))
    kept = rows(stages[0])
    gone = [before[i].text for i in before.keys() - kept.keys()]
    assert len(gone) <= 0.02 * len(before)
    assert all(kept[i] == before[i] for i in kept)


def test_one_document_of_each_group(stages):
    before, after = rows(stages[0]), rows(stages[1])
    groups = plain_groups([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, _, c in groups if i == c}
    assert all(after[i] == before[i] for i in after)


def test_no_personal_data_is_left(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert pii.base_spans(r.text) == []
        assert r.n_chars == len(r.text)
        if not pii.base_spans(before[i].text):
            assert r.text == before[i].text or "<id>" in r.text


def test_mix_repeats_documents(stages):
    before = rows(stages[2])
    times = {}
    for r in stages[3].collect():
        assert r == before[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times and max(times.values()) <= 3


def test_tokens(stages):
    library = Tokenizer.from_file(queries.tokenizer(queries.BPE_FILE))
    before = rows(stages[3])
    assert stages[4].count() == stages[3].count()
    for r in stages[4].collect():
        assert r.ids == library.encode(before[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_documents(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "1234 5678", "en", "s", 9), (None, "der die das und nicht", "de", "s", 21)], docs.schema)
    kept = rows(corpus_pipeline.identify_language(spark, docs.union(odd), SMALL))
    assert not {9001, 9002, 9003} & kept.keys() and None in kept
    double = docs.limit(5).union(docs.limit(5)).union(odd)
    left = corpus_pipeline.drop_near_copies(spark, double, SMALL).collect()
    assert len(left) == len({r.doc_id for r in left}) and None in {r.doc_id for r in left}
    assert langid.UND == "und"
