"""Quality rules: a base of counted features and a learned decision list, in DataFrame functions throughout.

The list is learned by sequential covering. Labelled documents become vectors of threshold levels; Spark counts each
level vector by label, and the covering works on these counts, whose number is bounded by the levels and not by the
documents: a rule grows condition by condition while that raises its precision (shrunk for small support), is pruned
on other documents, and joins the list if it is precise there; what it covers leaves. The result is an ordered chain
of conjunctions of thresholds, emitted as one Spark conditional expression.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

WS = r"[\x20\x09-\x0D]+"
#: Everything but the symbols, and but white space.
NO_SYMBOL, NO_SPACE = r"[^#*$%&|<>]+", r"[^\x20\x09-\x0D]+"
#: Thresholds of each ratio, from which conditions are made.
LEVELS = {
    "symbol_ratio": [0.002, 0.01, 0.03, 0.1, 0.2],
    "upper_ratio": [0.08, 0.15, 0.3, 0.6],
    "mark_ratio": [0.06, 0.12, 0.25, 0.4],
    "dup_line_ratio": [0.05, 0.15, 0.3, 0.5],
    "repeat_ratio": [0.1, 0.2, 0.35],
    "mean_word": [3.0, 4.0, 6.5, 9.0, 12.0],
}
#: Base rule: fewest words, and highest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEAT = 50, 50
#: Rules of a list, conditions of a rule.
MOST_RULES, MOST_CONDITIONS = 8, 3
#: Precision and support that a rule needs on documents it was not grown on, and the pseudo-count of its growing.
PRECISION, LEAST_SUPPORT, SHRINK = 0.9, 5, 4.0

#: (feature, threshold, at or above it rather than below)
Condition = tuple[str, float, bool]


def features(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_marks (longs).

    A null text counts as empty: all are 0. Windows that occur twice are found by sorting a text's own window hashes
    (64 bits), so nothing is shuffled. Helper arrays are columns, as an array inside a lambda would be made anew for
    each element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns(
        {
            "w_": F.filter(F.split(text, WS), lambda w: w != ""),
            "l_": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
            "word_chars": (F.length(text) - F.length(F.regexp_replace(text, NO_SPACE, ""))).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, NO_SYMBOL, "")).cast("long"),
            "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
            "n_marks": F.length(F.regexp_replace(text, r"[^\p{Punct}]+", "")).cast("long"),
        }
    )
    w = F.col("w_")
    windows = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    docs = docs.withColumn("s_", F.array_sort(F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0)))))
    s = F.col("s_")
    same = lambda a, b: a.getField("h") == b.getField("h")
    # beyond the ends get() is null, and so is the comparison
    twice = F.filter(s, lambda e, i: F.coalesce(same(e, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(e, F.get(s, i - 1)), F.lit(False)))
    docs = docs.withColumn("p_", F.array_sort(F.transform(twice, lambda e: e.getField("i"))))
    # positions of repeated windows in order: each covers three words, or as many as there are up to the next one
    covered = F.aggregate(
        "p_",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda a, i: F.struct((a.getField("n") + F.least(F.lit(3), i - a.getField("at"))).alias("n"), i.alias("at")),
    ).getField("n")
    return docs.withColumns(
        {
            "n_words": F.size("w_").cast("long"),
            "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
            "n_lines": F.size("l_").cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    ).drop("w_", "l_", "s_", "p_")


def ratios() -> dict[str, Column]:
    """The features that conditions are about; 0 where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "upper_ratio": over("n_upper", "word_chars"),
        "mark_ratio": over("n_marks", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
        "mean_word": over("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))


def statistics(counted: DataFrame, levels: dict[str, list[float]] = LEVELS) -> list[tuple[tuple[int, ...], bool, bool, int]]:
    """(level vector, held back for pruning, bad, documents) of counted (doc_id, bad, features ...).

    The level of a value is the number of thresholds that it reaches. A third of the documents, by hash, is held back.
    There are at most twice twice the product of the numbers of levels of rows.
    """
    level = {k: sum((F.when(ratios()[k] >= t, 1).otherwise(0) for t in ts), F.lit(0)) for k, ts in levels.items()}
    back = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) == 0
    rows = counted.select(*[c.alias(k) for k, c in level.items()], back.alias("back"), "bad").groupBy(*levels, "back", "bad").count()
    return [(tuple(r[k] for k in levels), r["back"], r["bad"], r["count"]) for r in rows.collect()]


def learn(stats: list[tuple[tuple[int, ...], bool, bool, int]], levels: dict[str, list[float]] = LEVELS) -> list[list[Condition]]:
    """An ordered list of conjunctions, each of which says "bad"; empty without labelled rows."""
    names = list(levels)
    every = [(k, i + 1, up) for k, name in enumerate(names) for i in range(len(levels[name])) for up in (True, False)]

    def covers(rule: list[tuple[int, int, bool]], v: tuple[int, ...]) -> bool:
        return all((v[k] >= i) == up for k, i, up in rule)

    def counts(rule: list[tuple[int, int, bool]], rows: list) -> tuple[int, int]:
        bad = all_ = 0
        for v, _, b, n in rows:
            if covers(rule, v):
                all_ += n
                bad += n * b
        return bad, all_

    left, out = sorted(stats), []
    while len(out) < MOST_RULES:
        grow, prune = [r for r in left if not r[1]], [r for r in left if r[1]]
        bad, all_ = counts([], grow)
        if not bad:
            break
        prior = bad / all_
        rule, best, inside = [], prior, grow
        while len(rule) < MOST_CONDITIONS:
            tried = []
            for c in every:
                b, n = counts([c], inside)
                if n >= LEAST_SUPPORT:
                    tried.append(((b + SHRINK * prior) / (n + SHRINK), b, c))
            if not tried or max(tried)[0] <= best:
                break
            best, _, c = max(tried)
            rule, inside = [*rule, c], [r for r in inside if covers([c], r[0])]

        def worth(r: list) -> float:
            b, n = counts(r, prune)
            return (b + SHRINK * prior) / (n + SHRINK)

        while len(rule) > 1 and (shorter := max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        b, n = counts(rule, prune)
        if not rule or n < LEAST_SUPPORT or b < PRECISION * n:
            break
        out.append([(names[k], levels[names[k]][i - 1], up) for k, i, up in rule])
        left = [r for r in left if not covers(rule, r[0])]
    return out


def as_column(rules: list[list[Condition]]) -> Column:
    """1, 2, ... for the first rule that covers a document, 0 for none: one ordered conditional expression."""
    about, out = ratios(), None
    for k, rule in enumerate(rules, 1):
        test = reduce(and_, [about[name] >= t if up else about[name] < t for name, t, up in rule])
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The features of docs (doc_id, text, ...), without text, and base_failed, rule (int, 0: none) and kept.

    labels: (doc_id, bad boolean) to learn from; null ids or labels are left out, and of several labels of one id the
    bad one counts. Without labels the list is empty and the base rule alone decides. A null or empty text has no
    words, so it fails the base rule. Repeated rows get equal verdicts; further columns are kept.
    """
    counted = materialize(features(docs).drop("text"))
    one = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    rules = learn(statistics(counted.drop("bad").join(one, "doc_id")))
    out = counted.withColumns({"base_failed": base_failed(), "rule": as_column(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
