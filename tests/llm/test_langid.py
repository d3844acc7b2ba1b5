"""Segmentation-marginalised unigrams against enumeration, held-out accuracy, odd texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from compare import SMALL

from lexiforge.llm import langid, queries

PIECES = ["▁", "a", "b", "ab", "▁a", "ba"]


def all_cuts(s):
    if not s:
        return [[]]
    return [[s[:i], *rest] for i in range(1, min(len(s), langid.PIECE_CHARS) + 1) for rest in all_cuts(s[i:])]


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    logp = np.log(r.dirichlet(np.ones(len(PIECES)), 2)).T
    model = langid.Model(["x", "y"], PIECES, logp)
    words = ["abba", "a", "bab", "aabab", "cab"]
    got = model.score(words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            p = {x: math.exp(logp[i, k]) for i, x in enumerate(PIECES)}
            floor = math.exp(langid.UNKNOWN)
            total = sum(math.prod(p.get(x, floor if len(x) == 1 else 0.0) for x in cut) for cut in all_cuts("▁" + w))
            assert row[k] == pytest.approx(math.log(total))


def test_expected_counts_add_up():
    p = {"▁": 0.2, "a": 0.3, "b": 0.2, "ab": 0.2, "▁a": 0.1}
    counts = langid.expected({"ab": 3}, p, 1e-6)
    assert sum(len(x) * n for x, n in counts.items()) == pytest.approx(3 * 3)  # every character is covered once
    cuts = {tuple(c): math.prod(p.get(x, 0.0) for x in c) for c in all_cuts("▁ab")}
    assert counts["ab"] == pytest.approx(3 * cuts["▁", "ab"] / sum(cuts.values()))


def test_long_words_do_not_vanish():
    model = langid.Model(["x"], ["▁"], np.array([[-1.0]]))
    assert np.isfinite(model.score(["q" * 5000])).all()


def test_a_long_word_has_the_sum_of_the_plain_recursion():
    """5000 letters with pieces of up to 12: against the recursion in exact logarithms, letter by letter."""
    r = np.random.default_rng(8)
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "abbabbaabbab", "▁ab"]
    logp = np.log(r.dirichlet(np.ones(len(pieces)), 2)).T
    word = "".join(r.choice(["a", "b", "abbabbaabbab", "c"], 5000))[:5000]
    got = langid.Model(["x", "y"], pieces, logp).score([word])[0]
    for k in range(2):
        p, s, alpha = dict(zip(pieces, logp[:, k], strict=True)), "▁" + word, [0.0]
        for j in range(1, len(s) + 1):
            terms = [alpha[i] + p.get(s[i:j], langid.UNKNOWN if j - i == 1 else -math.inf) for i in range(max(0, j - 12), j)]
            alpha.append(np.logaddexp.reduce(terms))
        assert got[k] == pytest.approx(alpha[-1])


def test_numbers_that_look_like_letters_are_none(spark):
    texts = ["½", "²", "Ⅷ", "①", "١٢", "_", "x²"]
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.tokenizer(queries.PIECES_FILE))
    got = {r.text: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert all(got[t] == (langid.UND, 0.0) for t in texts[:-1]) and got["x²"][0] in model.langs


def test_query_against_plain_sums(spark, tmp_path):
    """The whole query: its model from plain counts and expectation steps, its scores from plain forward sums."""
    docs = [(r.doc_id, r.text and r.text[:300], r.lang, r.source, 1) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(45).collect()]
    docs += [(900, None, "en", "s", 0), (901, "12 ½", None, "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op4_language_id(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    words = defaultdict(Counter)
    for i, text, lang, *_ in docs:
        if not held[i] and text is not None and lang is not None:
            words[lang].update(regex.findall(r"\p{L}+", text.lower()))
    vocabulary = langid.read_vocabulary(queries.tokenizer(queries.PIECES_FILE))
    most, floor = max(map(len, vocabulary)), math.exp(langid.UNKNOWN)
    pieces = sorted({*vocabulary, "▁", *"".join("".join(ws) for ws in words.values())})

    def sums(s, p):
        a = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            a[j] = sum(a[i] * p.get(s[i:j], floor if j - i == 1 else 0.0) for i in range(max(0, j - most), j))
        return a

    def norm(counts):
        total = sum(counts.get(x, 0) for x in pieces) + langid.SMOOTH * len(pieces)
        return {x: (counts.get(x, 0) + langid.SMOOTH) / total for x in pieces}

    model = {}
    for lang, ws in words.items():
        counts = Counter()
        for w, n in ws.items():
            s = "▁" + w
            counts.update({x: n * sum(s.startswith(x, i) for i in range(len(s))) for x in {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}})
        p = norm(counts)
        for _ in range(langid.ROUNDS):
            counts = Counter()
            for w, n in ws.items():
                s = "▁" + w
                a, back = sums(s, p), sums(s[::-1], {x[::-1]: q for x, q in p.items()})[::-1]
                for i in range(len(s)):
                    for j in range(i + 1, min(len(s), i + most) + 1):
                        if s[i:j] in p:
                            counts[s[i:j]] += n * a[i] * p[s[i:j]] * back[j] / a[-1]
            p = norm(counts)
        model[lang] = p
    assert len(rows) == len(docs) and len(model) > 1
    for i, text, *_ in docs:
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        total = {g: sum(math.log(sums("▁" + w, p)[-1]) for w in found) / math.sqrt(len(found)) for g, p in model.items()}
        best = max(sorted(total), key=total.get)
        assert rows[i].lang_pred == best and rows[i].held_out == held[i]
        assert rows[i].score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, weird):
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), queries.tokenizer(queries.PIECES_FILE))
    rows = langid.predict(weird, model).collect()
    assert len(rows) == weird.count()
    for r in rows:
        if not r.text or not regex.search(r"\p{L}", r.text):
            assert (r.lang_pred, r.score) == (langid.UND, 0.0)
        else:
            assert r.lang_pred in model.langs
    assert langid.predict(weird.limit(0), model).collect() == []


def test_no_training_rows(spark, weird):
    model = langid.fit(weird.limit(0), queries.tokenizer(queries.PIECES_FILE))
    assert {r.lang_pred for r in langid.predict(weird, model).collect()} == {langid.UND}


def test_forgetting_words_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    model = langid.fit(docs, queries.tokenizer(queries.PIECES_FILE))
    first = sorted(map(tuple, langid.predict(docs, model).select("doc_id", "lang_pred").collect()))
    monkeypatch.setattr(langid, "TASK_WORDS", 5)
    assert sorted(map(tuple, langid.predict(docs, model).select("doc_id", "lang_pred").collect())) == first


LONG = ["a" * 12, "▁" + "ab" * 5, "b" * 9]


def log_sum(w, p, floor):
    """Log of the sum over all segmentations, in log space and of any length."""
    s, most = "▁" + w, max(map(len, p))
    at = [0.0]
    for j in range(1, len(s) + 1):
        ways = [at[i] + math.log(q) for i in range(max(0, j - most), j) if (q := p.get(s[i:j], floor if j - i == 1 else 0.0))]
        at.append(float(np.logaddexp.reduce(ways)))
    return at[-1]


@pytest.mark.parametrize("w", ["a" * 11, "ab" * 5, "a" * 20 + "ab" * 10, "abab" * 60, "q" * 300 + "a" * 40])
def test_long_pieces_and_long_words(w):
    pieces = sorted(PIECES + LONG)
    r = np.random.default_rng(2)
    logp = np.log(r.dirichlet(np.ones(len(pieces)), 2)).T
    row = langid.Model(["x", "y"], pieces, logp).score([w])[0]
    for k in range(2):
        p = {x: math.exp(logp[i, k]) for i, x in enumerate(pieces)}
        assert row[k] == pytest.approx(log_sum(w, p, math.exp(langid.UNKNOWN)))
        counts = langid.expected({w: 2}, p, math.exp(langid.UNKNOWN))
        assert sum(len(x) * n for x, n in counts.items()) == pytest.approx(2 * (len(w) + 1))


def test_vocabulary_is_whole():
    found = langid.read_vocabulary(queries.tokenizer(queries.PIECES_FILE))
    assert {"▁application", "abilities"} & set(found) and max(map(len, found)) > 8
