"""Text analysis: tokens, stop words, hashes, snippets and highlighting, as column expressions."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words, tested on lower-cased tokens before stemming.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with without about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now would
""".split()

STOPS, LETTERS = frozenset(STOP_WORDS), regex.compile(r"\p{L}+")
#: Characters around a token in a snippet, and snippets kept of a posting.
AROUND, MOST_SNIPPETS = 150, 3
NO_PREVIEW, NO_CONTENT = "No preview available", "Relevant content not available"


def tokens(text: Column) -> Column:
    """Runs of letters that are ASCII throughout, in lower case; an accented letter drops its whole run.

    Null and blank texts have none.
    """
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+"), 0)
    return F.transform(F.filter(runs, lambda x: x.rlike("^[a-zA-Z]+$")), F.lower)


def kept(text: Column) -> Column:
    """Tokens without stop words and single letters: those that count, in order."""
    return F.filter(tokens(text), lambda x: ~x.isin(STOP_WORDS) & (F.length(x) > 1))


def kept_tokens(text: str | None) -> list[str]:
    """kept() of one text, for Arrow batches."""
    runs = LETTERS.findall(text or "")
    return [t for t in (r.lower() for r in runs if r.isascii()) if t not in STOPS and len(t) > 1]


def content_hash(text: Column) -> Column:
    """SHA-256 in lower-case hex without leading zeros."""
    return F.regexp_replace(F.sha2(text, 256), "^0+", "")


def publish_date(ms: Column) -> Column:
    """Milliseconds since the epoch as yyyy-MM-dd in the session's zone; empty for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit(""))


def snippet(text: str, low: str, token: str) -> str | None:
    """Text around the first place of token in low, the lower-cased text, as a substring; None if it is not there.

    Up to AROUND characters each side, but from the start of the token's sentence and to its end where those lie
    nearer; dots mark a cut.
    """
    i = low.find(token)
    if i < 0:
        return None
    n, after = len(text), i + len(token)
    start, end = max(0, i - AROUND), min(n, after + AROUND)
    if start > 0 and (stop := text.rfind(". ", start + 1, i + 2)) >= 0:
        start = stop + 2
    if end < n and (dot := text.find(".", i, i + AROUND)) >= 0:
        end = dot + 1
    return f"{'...' if start > 0 else ''}{text[start:i]}<strong>{text[i:after]}</strong>{text[after:end]}{'...' if end < n else ''}"


def first_snippets(text: Column, low: Column, tokens: Column) -> Column:
    """For each token its snippet, an array of (token, snippet); tokens that are not found are left out.

    Arrow batches rather than an expression: Spark's strings are UTF-8, so that each token would scan its text from
    the start several times. A text is not repeated for each of its tokens.
    """
    kind = "array<struct<token:string,snippet:string>>"

    @F.arrow_udf(kind)
    def made(texts: pa.Array, lows: pa.Array, each: pa.Array) -> pa.Array:
        out = []
        for t, w, ts in zip(texts, lows, each, strict=True):
            t, w = t.as_py(), w.as_py()
            found = [] if t is None else [(x, snippet(t, w, x)) for x in ts.as_py() or []]
            out.append([{"token": x, "snippet": s} for x, s in found if s is not None])
        return pa.array(out, pa.list_(pa.struct([("token", pa.string()), ("snippet", pa.string())])))

    return made(text, low, tokens)


def best_three(snippets: Column) -> Column:
    """At most three snippets: all in order if they are three or fewer, else those with a full stop first, then the
    longer; equals keep their order."""
    keyed = F.transform(snippets, lambda s, i: F.struct((~s.contains(".")).cast("int").alias("a"), (-F.length(s)).alias("b"), i.alias("c"), s.alias("s")))
    ranked = F.transform(F.slice(F.array_sort(keyed), 1, MOST_SNIPPETS), lambda x: x.getField("s"))
    return F.when(F.size(snippets) <= MOST_SNIPPETS, snippets).otherwise(ranked)


def best_three_of(snippets: list[str]) -> list[str]:
    """best_three() of one list."""
    if len(snippets) <= MOST_SNIPPETS:
        return snippets
    keyed = ((("." not in s), -len(s), i) for i, s in enumerate(snippets))
    return [snippets[i] for *_, i in heapq.nsmallest(MOST_SNIPPETS, keyed)]


def first_best(items: Column, score: Callable[[Column], Column]) -> Column:
    """The item with the highest score; of equal scores the first."""
    keyed = F.transform(items, lambda s, i: F.struct((-score(s)).alias("a"), i.alias("b"), s.alias("s")))
    return F.array_min(keyed).getField("s")


def best_snippet(snippets: Column, stem: Column) -> Column:
    """For a term query: the snippet with the stem marked (3), or contained (1), before others; the first of equals."""

    def score(s: Column) -> Column:
        low = F.lower(s)
        has = F.instr(low, stem) > 0
        return F.when(has & (F.instr(low, F.concat(F.lit("<strong>"), stem, F.lit("</strong>"))) > 0), 3).when(has, 1).otherwise(0)

    return F.when(F.coalesce(F.size(snippets), F.lit(0)) <= 0, NO_PREVIEW).otherwise(first_best(snippets, score))


def central_score(s: Column, term: Column) -> Column:
    """100 less the distance of the term from the snippet's middle (0 at least), 50 more if it is marked; 0 if absent."""
    at = F.instr(F.lower(s), F.lower(term)) - 1
    near = 100 - F.least(F.lit(100), F.abs(at - F.floor(F.length(s) / 2)))
    marked = F.instr(F.lower(s), F.concat(F.lit("<strong>"), F.lower(term), F.lit("</strong>"))) > 0
    return F.when(at >= 0, near + F.when(marked, 50).otherwise(0)).otherwise(0)


def joined_snippets(snippets: Column, terms: list[str]) -> Column:
    """Several terms' snippets in one line: for each term the one with the highest central_score (the first of equals),
    each once, three at most. A single snippet stands alone; without any there is no preview."""
    each = F.array_distinct(F.array(*[first_best(snippets, lambda s, t=t: central_score(s, F.lit(t))) for t in terms]))
    out = F.array_join(F.slice(each, 1, MOST_SNIPPETS), " ... | ... ")
    return F.when(F.coalesce(F.size(snippets), F.lit(0)) <= 0, NO_PREVIEW).otherwise(out)


def phrase_score(s: Column, terms: list[str]) -> Column:
    """100 for the whole phrase, 50 for its terms in order, 20 for each marked term."""
    low = F.lower(s)
    out = F.when(F.instr(low, " ".join(terms)) > 0, 100).otherwise(0)
    at = [F.instr(low, t) for t in terms]
    order = at[0] > 0
    for a, b in zip(at, at[1:], strict=False):
        order = order & (b > 0) & (b >= a)
    out = out + F.when(order, 50).otherwise(0)
    for t in terms:
        out = out + F.when(F.instr(low, f"<strong>{t}</strong>") > 0, 20).otherwise(0)
    return out


def phrase_snippet(snippets: list[Column], terms: list[str]) -> Column:
    """Of the snippet arrays of a phrase's terms: those of the first term which all others share, else which the last
    shares, else the first term's first; the best by phrase_score. A term without snippets leaves no preview."""
    first, others = snippets[0], snippets[1:]
    shared = first
    for o in others:
        shared = F.array_intersect(shared, o)
    last = F.filter(first, lambda s: F.array_contains(snippets[-1], s))
    chosen = F.when(F.size(shared) > 0, shared).when(F.size(last) > 0, last).otherwise(F.slice(first, 1, 1))
    some = [F.coalesce(F.size(s), F.lit(0)) > 0 for s in snippets]
    all_ = some[0]
    for s in some[1:]:
        all_ = all_ & s
    return F.when(all_, first_best(chosen, lambda s: phrase_score(s, terms))).otherwise(NO_CONTENT)


def highlight(text: Column, words: list[str]) -> Column:
    """Whole words marked, whatever their case, which is kept. Letters beside a match make it no whole word."""
    good = sorted({w.lower() for w in words if w.isascii() and w.isalpha()}, key=lambda w: (-len(w), w))
    if not good:
        return text
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(good)})(?![\p{{L}}\p{{N}}_])", "<strong>$1</strong>")
