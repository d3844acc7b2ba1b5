"""Porter's stemmer as an ordered cascade of suffix rules, for Spark columns and for SQL.

A word is C?(VC)^m V? in runs of consonants C and vowels V; m is its measure. Each step takes the longest of its
suffixes that the word ends with and replaces it if the part before it meets the rule's condition, or else does
nothing. An initial y is a consonant and is held as Y in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
CONDITIONS = {
    "m>0": f"^({C})?{V}{C}",
    "m>1": f"^({C})?{V}{C}{V}{C}",
    "vowel": f"^({C})?[aeiouy]",
    "cvc": f"^{C}[aeiouy][^aeiouwxy]$",
}
#: Marks a word from which -ed or -ing was taken, for the step after it.
CUT = "^"

#: Fixed values of the published algorithm: (suffix, condition on what precedes it, replacement).
STEPS: list[list[tuple[str, str, str]]] = [
    [("sses", "", "ss"), ("ies", "", "i"), ("ss", "", "ss"), ("s", "", "")],
    [("eed", "m>0", "ee"), ("ed", "vowel", CUT), ("ing", "vowel", CUT)],
    [("at" + CUT, "", "ate"), ("bl" + CUT, "", "ble"), ("iz" + CUT, "", "ize")]
    + [(c + c + CUT, "", c) for c in "bdfgmnprt"]
    + [(CUT, "cvc", "e")],
    [(CUT, "", "")],
    [("y", "vowel", "i")],
    [
        ("ational", "m>0", "ate"), ("ization", "m>0", "ize"), ("fulness", "m>0", "ful"), ("ousness", "m>0", "ous"),
        ("iveness", "m>0", "ive"), ("tional", "m>0", "tion"), ("biliti", "m>0", "ble"), ("entli", "m>0", "ent"),
        ("ousli", "m>0", "ous"), ("ation", "m>0", "ate"), ("alism", "m>0", "al"), ("aliti", "m>0", "al"),
        ("iviti", "m>0", "ive"), ("enci", "m>0", "ence"), ("anci", "m>0", "ance"), ("abli", "m>0", "able"),
        ("izer", "m>0", "ize"), ("ator", "m>0", "ate"), ("alli", "m>0", "al"), ("eli", "m>0", "e"),
    ],
    [
        ("icate", "m>0", "ic"), ("ative", "m>0", ""), ("alize", "m>0", "al"), ("iciti", "m>0", "ic"),
        ("ical", "m>0", "ic"), ("ness", "m>0", ""), ("ful", "m>0", ""),
    ],
    [
        ("ement", "m>1", ""), ("ance", "m>1", ""), ("ence", "m>1", ""), ("able", "m>1", ""), ("ible", "m>1", ""),
        ("ment", "m>1", ""), ("ant", "m>1", ""), ("ent", "m>1", ""), ("ism", "m>1", ""), ("ate", "m>1", ""),
        ("iti", "m>1", ""), ("ous", "m>1", ""), ("ive", "m>1", ""), ("ize", "m>1", ""), ("ion", "m>1 after s or t", ""),
        ("al", "m>1", ""), ("er", "m>1", ""), ("ic", "m>1", ""), ("ou", "m>1", ""),
    ],
    [("e", "m>1, or m=1 and not cvc", "")],
    [("l", "m>1 after l", "")],
]


COMPILED = {name: re.compile(pattern) for name, pattern in CONDITIONS.items()}


def stem_word(word: str) -> str | None:
    """The stem of one word, for the words of a query and the distinct words that a task meets."""
    w = word.lower()
    if len(w) < 2 or re.fullmatch("[0-9]+", w):
        return None
    if len(w) <= 3:
        return w
    out = "Y" + w[1:] if w[0] == "y" else w

    def holds(part: str, name: str) -> bool:
        return COMPILED[name].search(part) is not None

    def meets(part: str, name: str) -> bool:
        if name == "m>1 after s or t":
            return part[-1:] in ("s", "t") and holds(part, "m>1")
        if name == "m>1 after l":
            return part[-1:] == "l" and holds(part, "m>1")
        if name == "m>1, or m=1 and not cvc":
            return holds(part, "m>1") or (holds(part, "m>0") and not holds(part, "cvc"))
        return not name or holds(part, name)

    for rules in STEPS:
        for suffix, name, by in rules:
            if out.endswith(suffix):
                part = out[: len(out) - len(suffix)]
                out = part + by if meets(part, name) else out
                break
    return out.replace("Y", "y")


def condition(stem: Column, name: str) -> Column:
    holds = lambda k: stem.rlike(CONDITIONS[k])
    if name == "m>1 after s or t":
        return holds("m>1") & stem.rlike("[st]$")
    if name == "m>1 after l":
        return holds("m>1") & stem.endswith("l")
    if name == "m>1, or m=1 and not cvc":
        return holds("m>1") | (holds("m>0") & ~holds("cvc"))
    return holds(name)


def step(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    out = None
    for suffix, name, by in rules:
        stem = F.left(word, F.length(word) - len(suffix))
        new = F.concat(stem, F.lit(by))
        new = F.when(condition(stem, name), new).otherwise(word) if name else new
        out = F.when(word.endswith(suffix), new) if out is None else out.when(word.endswith(suffix), new)
    return out.otherwise(word)


def bound(rules: list[tuple[str, str, str]]) -> Callable[[Column], Column]:
    return lambda x: step(x, rules)


def stem(word: Column) -> Column:
    """The stem of a word: null for null, one-letter and all-digit words; words of two or three letters as they are,
    in lower case. A hundred pattern tests, so meant for distinct words.

    Each step's result is bound to a lambda variable: as a plain expression it would be repeated in every test of the
    next step, and again whenever a filter on the stem is pushed below it.
    """
    w = F.lower(word)
    out = F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, 2, 1 << 30))).otherwise(w)
    for rules in STEPS:
        out = F.get(F.transform(F.array(out), bound(rules)), F.lit(0))
    out = F.when(F.length(w) <= 3, w).otherwise(F.replace(out, F.lit("Y"), F.lit("y")))
    return F.when((F.length(w) > 1) & ~w.rlike("^[0-9]+$"), out)


def sql_condition(stem: str, name: str) -> str:
    holds = lambda k: f"regexp_matches({stem}, '{CONDITIONS[k]}')"
    if name == "m>1 after s or t":
        return f"{holds('m>1')} AND regexp_matches({stem}, '[st]$')"
    if name == "m>1 after l":
        return f"{holds('m>1')} AND ends_with({stem}, 'l')"
    if name == "m>1, or m=1 and not cvc":
        return f"({holds('m>1')} OR ({holds('m>0')} AND NOT {holds('cvc')}))"
    return holds(name)


def sql_stems(words: str, word: str = "word", stem: str = "stem") -> str:
    """SELECT over words (a table or subquery with the column word) with the same cascade."""
    w = f"lower({word})"
    out = f"SELECT *, CASE WHEN starts_with({w}, 'y') THEN 'Y' || substr({w}, 2) ELSE {w} END AS {stem} FROM {words}"
    for rules in STEPS:
        case = ""
        for suffix, name, by in rules:
            part = f"left({stem}, length({stem}) - {len(suffix)})"
            new = f"{part} || '{by}'"
            new = f"CASE WHEN {sql_condition(part, name)} THEN {new} ELSE {stem} END" if name else new
            case += f" WHEN ends_with({stem}, '{suffix}') THEN {new}"
        out = f"SELECT * REPLACE (CASE{case} ELSE {stem} END AS {stem}) FROM ({out})"
    last = f"CASE WHEN length({w}) <= 1 OR regexp_full_match({w}, '[0-9]+') THEN NULL WHEN length({w}) <= 3 THEN {w} ELSE replace({stem}, 'Y', 'y') END"
    return f"SELECT * REPLACE ({last} AS {stem}) FROM ({out})"
