"""Decision list (features by brute force, learning, verdicts) and FTRL classifier (held-out accuracy)."""

import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import SMALL


from lexiforge.llm import decision_list, ftrl_quality, queries

MEDIUM = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_features(spark, weird):
    more = spark.createDataFrame([(60, "a b c a b c a"), (61, "a a a a"), (62, "x\n\nx\n x\ny\ny\n \n"), (63, "a b c d"), (64, "#$%&* <>| \U0001f600\U0001f600")], "doc_id long, text string")
    docs = weird.unionByName(more, allowMissingColumns=True)
    for r in decision_list.features(docs).collect():
        assert tuple(r[n] for n in NAMES) == plain(r.text), r.text


def test_query_base(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op3_quality_rules(spark, SMALL).collect():
        n, *_, repeat = base = plain(texts[r.doc_id])
        assert tuple(r[c] for c in NAMES) == base
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    plan = decision_list.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_learning_finds_planted_rules():
    levels = {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0]}
    stats = [((a, b), back, (a >= 2 and b < 1) or a == 3, 40) for a in range(4) for b in range(3) for back in (False, True)]
    rules = decision_list.learn(stats, levels)
    bad = lambda v: any(all((v[n] >= t) == up for n, t, up in rule) for rule in rules)
    for (a, b), _, is_bad, _ in stats:
        value = {"a": [0.0, 1.0, 2.0, 3.0][a], "b": [0.0, 1.0, 2.0][b]}
        assert bad(value) == is_bad
    assert decision_list.learn([], levels) == []


def test_odd_labels(spark, weird):
    labels = spark.createDataFrame([(None, True), (0, None), (1, True), (1, False)], "doc_id long, bad boolean")
    out = decision_list.judge(weird, labels)
    assert out.count() == weird.count() and "score" in out.columns
    assert out.where("text_ is not null").count() == 0 if "text_" in out.columns else True
    assert decision_list.judge(weird.limit(0), labels.limit(0)).collect() == []


def accuracy(spark, name, column, folder=MEDIUM):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r[column], r) for r in queries.queries()[name](spark, folder).collect() if r.doc_id in labels]
    return rows


def test_decision_list_keeps_good_and_drops_bad(spark):
    rows = accuracy(spark, "op3_quality_rules", "kept")
    good = [k for q, k, r in rows if q == 1 and not r.base_failed]
    bad = [k for q, k, _ in rows if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_classifier_held_out(spark):
    rows = [(q, p) for q, p, r in accuracy(spark, "op7_quality_classifier", "predicted") if r.held_out]
    assert np.mean([p for q, p in rows if q == 1]) >= 0.98
    assert np.mean([p for q, p in rows if q == 0]) <= 0.5  # a handful of rows, of a small training set


def test_classifier_ignores_everything_but_text(spark, weird):
    model = (np.ones(ftrl_quality.DIMS) * 0.1, 0.2)
    rows = ftrl_quality.score(weird, model).collect()
    assert len(rows) == weird.count() and all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if not (r.text or "").strip()]
    assert empty and all(s == pytest.approx(1 / (1 + np.exp(-0.2))) for s in empty)
    assert len({r.score for r in rows if r.text == "dup dup"}) == 1
    assert ftrl_quality.score(weird.limit(0), model).collect() == []


def test_untrained_and_reproducible(spark):
    w, b = ftrl_quality.train([])
    assert not w.any() and b == 0
    make = ftrl_quality.Features()
    rows = [(*make("good clean words here"), 1), (*make("bad *** !!! ***"), 0)] * 20
    first, again = ftrl_quality.train(rows), ftrl_quality.train(rows)
    assert (first[0] == again[0]).all() and first[1] == again[1]
    score = lambda t: (lambda i, v: first[0][i].sum() * v + first[1])(*make(t))
    assert score("good clean") > 0 > score("*** !!!")


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None), (5, 0)], "key long, label int")
    assert ftrl_quality.sample_keys(labels, 10).count() == 10
    assert ftrl_quality.sample_keys(labels).count() == 100


def test_verdicts_against_plain_rules(spark):
    """A conjunction is planted (many symbols and many capitals together); statistics and verdicts are redone plainly."""
    r = np.random.default_rng(6)
    texts, bad = [], []
    for i in range(900):
        words = ["".join(r.choice(list("abcdefgh"), int(r.integers(3, 9)))) for _ in range(int(r.integers(55, 90)))]
        loud, odd = i % 3 == 0, i % 2 == 0
        words = [w.upper() if loud and r.random() < 0.6 else w for w in words]
        words = [w + "#" if odd and r.random() < 0.7 else w for w in words]
        texts.append(" ".join(words))
        bad.append(loud and odd)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in decision_list.judge(docs, spark.createDataFrame(list(enumerate(bad)), "doc_id long, bad boolean")).collect()}
    back = {x.doc_id: x.b for x in docs.selectExpr("doc_id", "pmod(xxhash64(cast(doc_id as string)), 3) = 0 as b").collect()}
    over = lambda a, b: a / b if b else 0.0

    def plain_ratios(t):
        n, chars, symbols, dups, repeat = plain(t)
        lines = [x for x in t.split("\n") if x.strip()]
        return {
            "symbol_ratio": over(symbols, chars), "upper_ratio": over(sum(c.isupper() for c in t), chars), "dup_line_ratio": over(dups, len(lines)),
            "mark_ratio": over(sum(c in string.punctuation for c in t), chars), "repeat_ratio": over(repeat, n), "mean_word": over(chars, n),
        }

    values = [plain_ratios(t) for t in texts]
    counts = Counter((tuple(sum(v[k] >= x for x in xs) for k, xs in decision_list.LEVELS.items()), back[i], bad[i]) for i, v in enumerate(values))
    rules = decision_list.learn([(*k, n) for k, n in counts.items()])
    assert any(len(rule) > 1 for rule in rules)
    for i, v in enumerate(values):
        fired = [k for k, rule in enumerate(rules, 1) if all((v[n] >= t) == up for n, t, up in rule)]
        assert (got[i].rule, got[i].kept) == (fired[0] if fired else 0, not fired and not got[i].base_failed)
    assert np.mean([got[i].kept != bad[i] for i in range(900)]) > 0.97


def plain_ftrl(rows, dims, epochs):
    """FTRL-proximal coordinate by coordinate, with dictionaries."""
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= ftrl_quality.L1:
            return 0.0
        return -(z[k] - math.copysign(ftrl_quality.L1, z[k])) / ((ftrl_quality.BETA + math.sqrt(n[k])) / ftrl_quality.ALPHA + ftrl_quality.L2)

    for _ in range(epochs):
        for index, value, label in rows:
            x = {**{int(k): value for k in index}, dims: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / ftrl_quality.ALPHA
                z[k] += g - s * w[k]
                n[k] += g * g
    return weight


def test_query_against_plain_training(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    at = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in docs], "doc_id long").selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as h").collect()}
    order = sorted((i for i in docs if i in labels and not held[i]), key=at.get)
    make, dims = ftrl_quality.Features(), ftrl_quality.DIMS
    weight = plain_ftrl([(*make(docs[i]), labels[i]) for i in order], dims, ftrl_quality.EPOCHS)
    rows = queries.op7_quality_classifier(spark, SMALL).collect()
    assert len(rows) == len(docs) and len(order) > 20
    for r in rows:
        index, value = make(docs[r.doc_id])
        score = 1 / (1 + math.exp(-(sum(weight(int(k)) for k in index) * value + weight(dims))))
        assert r.score == pytest.approx(score, abs=1e-5) and r.held_out == held[r.doc_id]
        assert r.predicted == int(r.score >= 0.3)


def test_features_by_definition():
    """Hashed words and pairs of neighbours, one feature for a word after itself."""
    mask, mix = (1 << 64) - 1, int(ftrl_quality.MIX)
    words = re.findall(r"\w+|[^\w\s]+", "a b, b b a a ünï 12")
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    pairs = [7 if x == y else (x * mix & mask) ^ (y >> 17) ^ y for x, y in zip(h, h[1:], strict=False)]
    want = set()
    for v in h + [p * mix & mask for p in pairs]:
        v ^= v >> 29
        want.add((v * mix & mask) >> 40 & (ftrl_quality.DIMS - 1))
    index, value = ftrl_quality.Features()("a b, b b a a ünï 12")
    assert index.tolist() == sorted(want) and value == pytest.approx(ftrl_quality.NORM / math.sqrt(len(want)))


def test_repeated_rows_of_a_key_count_once(spark):
    rows = [(i, f"good clean words {i}" if i % 2 else f"bad *** !!! {i}", i % 2) for i in range(40)]
    once = ftrl_quality.fit(spark.createDataFrame(rows, "key long, text string, label int"))
    often = ftrl_quality.fit(spark.createDataFrame(rows + rows[:1] * 3000, "key long, text string, label int"))
    assert (once[0] == often[0]).all() and once[1] == often[1]
