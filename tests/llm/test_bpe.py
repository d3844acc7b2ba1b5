"""BPE against the tokenizers library, and exact round trips."""

import hashlib

import pytest
from compare import SMALL

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiforge.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer(queries.BPE_FILE))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(queries.tokenizer_json())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_bpe(spark, SMALL).collect()}
    assert got == {i: expected(library, t) for i, t in texts.items()}


def test_odd_texts(spark, weird, library):
    extra = spark.createDataFrame([(90, "a<|endoftext|> b <|endoftext|>"), (91, "it's  I'LL\t\t\n x y ͸ ࢿ 日本語 ½²"), (92, "don't" * 50)], "doc_id long, text string")
    docs = weird.unionByName(extra, allowMissingColumns=True)
    out = bpe.encode(docs, queries.tokenizer_json())
    assert out.columns == [*docs.columns, "ids"] and out.count() == docs.count()
    for r in bpe.decode(out, queries.tokenizer_json()).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    rows = bpe.digests(docs, queries.tokenizer_json()).collect()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, r.text) for r in rows)


def test_small_head_and_forgetful_tasks_change_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "TASK_WORDS", 3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(20)
    table = bpe.word_table(docs, queries.tokenizer_json(), most=40)
    assert 0 < table.count() <= 40
    for r in bpe.encode(docs, queries.tokenizer_json(), table).collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_table_counts_every_word(spark, codec):
    docs = spark.createDataFrame([("a b a",), (None,), ("a",)], "text string")
    got = {r.word: r.n for r in bpe.count_words(docs, queries.tokenizer_json()).collect()}
    assert got == {"a": 2, " b": 1, " a": 1}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, queries.tokenizer_json()).collect() == []


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r  'sdt<|>endoftx.,0123½é日"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(codec, library, text):
    ids = [i for w in codec.encode(codec.words(text)) for i in w]
    assert ids == library.encode(text, add_special_tokens=False).ids
