"""Personal data: four base kinds by rule, and further identifiers by bootstrapped contextual extraction.

Seeds are the entities that the base rules find, of all four kinds. They and every other identifier-like stretch (a
token with several digits, spaced groups of digits, an address written out) yield patterns: the word before and the word
after, each with the stretch's shape and without it, and the shape alone. Mentions form a graph of patterns and
instances; scores go back and forth: a pattern is worth the mean worth of its mentions' instances, shrunk towards
nothing, and an instance that is no seed takes the mean of its patterns. After each round, instances for most of whose
mentions kept patterns vouch on two sides are seeds themselves, so that they teach contexts in which no base entity
stands. Patterns that end with high confidence and enough distinct seeds discover identifiers which no base rule admits
(a card number with a wrong check digit, say), marked as kind "id".
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, join_frequent, materialize, remove, small_batches

KINDS = ["email", "ip", "card", "phone"]
#: What the method adds.
FOUND = "id"

# The same matches as the plain patterns: a run of digits can only match from its start, so later starts are skipped.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left as far as the local part goes, and to the right; linear in the text."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m and at > free:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: An identifier-like token: letters, digits and joining marks.
TOKEN = re.compile(r"(?<![\w.+-])[0-9A-Za-z](?:[\w.-]{2,}[0-9A-Za-z])(?![\w-])", re.ASCII)
DIGIT, BLANK, WORD, RUN = re.compile("[0-9]"), re.compile(r"\s"), re.compile(r"\w"), re.compile(r"\S+")
#: Groups of digits with single marks between them, as phones and cards are written.
GROUPS = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:(?:\)[\x20-]?|[\x20.-]\(?)[0-9]{2,}+)++")
#: The at of an address, what may stand around it, and the domain after it.
AT = re.compile(r"[aA@](?:(?<=@)|[tT](?<=[\x20\[({<]..)(?=[\x20\])}>]))")
AT_END = re.compile(r"\x20?[\])}>]?\x20?")
DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
WRITTEN = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)+")
LABEL = re.compile(r"[A-Za-z0-9-]+")
#: Digits that a token needs to be considered, and to be so inside a longer candidate; digits of groups.
LEAST_DIGITS, INNER_DIGITS, GROUP_DIGITS = 4, 6, range(7, 20)


def shape(token: str) -> str:
    """Runs of digits and of letters with their lengths, other characters as they are."""
    return re.sub(r"[0-9]+|[A-Za-z]+", lambda m: ("d" if m[0][0].isdigit() else "a") + str(len(m[0])), token)


def key_of(s: str) -> str:
    """s, or its digest where it is long."""
    return s if len(s) <= 200 else hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def bare(word: str) -> str:
    return key_of(re.sub(r"[^\w]+", "", word).lower())


class Words:
    """The runs of a text between white space, to look up a stretch's neighbours."""

    def __init__(self, text: str) -> None:
        self.text, self.runs = text, [m.span() for m in RUN.finditer(text)]
        self.starts = [a for a, _ in self.runs]

    def before(self, at: int) -> str:
        """The word before at, if nothing but blanks and marks stands between."""
        k = bisect_left(self.starts, at) - 1
        if k >= 0 and self.runs[k][1] >= at:  # the run that at stands in or follows on
            i = at - 1
            while i >= self.starts[k]:
                if WORD.match(self.text[i]):
                    return ""
                i -= 1
            k -= 1
        return bare(self.text[slice(*self.runs[k])]) if k >= 0 else ""

    def after(self, at: int) -> str:
        """The word after at, likewise."""
        k = bisect_left(self.starts, at)
        if k and self.runs[k - 1][1] > at and WORD.search(self.text, at, self.runs[k - 1][1]):
            return ""
        return bare(self.text[slice(*self.runs[k])]) if k < len(self.runs) and (k == 0 or self.runs[k][0] > at) else ""


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """All matches of TOKEN, which is tried only around digits."""
    at = 0
    while m := DIGIT.search(text, at):
        start = max(text.rfind(" ", at, m.start()) + 1, at)
        at = end.start() if (end := BLANK.search(text, m.end())) else len(text)
        for t in TOKEN.finditer(text, start, at):
            yield t.span()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Stretches like an email address that is written out, or has no dot after a plain @."""
    free = 0
    for m in AT.finditer(text):
        last, end = m.start(), AT_END.match(text, m.end()).end()
        for marks in (" ", "[({<", " "):
            last -= last > free and text[last - 1] in marks
        start = last
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = start < last and (WRITTEN.match(text, end) or end - last == 1 and LABEL.match(text, end))
        if domain:
            free = domain.end()
            yield start, free


def digit_groups(text: str) -> Iterator[tuple[int, int]]:
    for m in GROUPS.finditer(text):
        a, b = m.span()
        if len(only_digits(m[0])) in GROUP_DIGITS and not text[b : b + 1].isalnum():
            for _ in "(+":
                a -= a > 0 and text[a - 1] in "(+"
            if not (a and (text[a - 1].isalnum() or text[a - 1] in "_.-")):
                yield a, b


def apart(spans: Iterator[tuple[int, int]], marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that overlap none of marks; both by start."""
    at = reach = 0
    out = []
    for a, b in spans:
        while at < len(marks) and marks[at][0] < b:
            reach = max(reach, marks[at][1])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


def candidates(text: str, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like stretches apart from marks: written addresses, groups of digits, and tokens. Tokens inside longer
    candidates need more digits, as parts of those else."""
    sized = [(span, len(only_digits(text[slice(*span)]))) for span in tokens(text)]
    longer = apart(sorted({*addresses(text), *digit_groups(text)}), marks)
    short = apart((span for span, n in sized if LEAST_DIGITS <= n < INNER_DIGITS), sorted([*marks, *longer]))
    return sorted({*longer, *short, *apart((span for span, n in sized if n >= INNER_DIGITS), marks)})


def mentions(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, list[str], bool]]:
    """(start, end, token, patterns, seed) of each base span, the seeds, and of each candidate.

    What overlaps a base span otherwise is part of it and no mention.
    """
    marks = sorted({(a, b) for _, a, b in base})
    exact = set(marks)
    every = sorted([*marks, *candidates(text, marks)])
    words = Words(text) if every else None
    for a, b in every:
        token = text[a:b]
        s, left, right = key_of(shape(token)), words.before(a), words.after(b)
        # the lexical ones hold no blank, the others do
        yield a, b, token, [f"<{left} {s}", f">{s} {right}", f"={s}", f"<{left}", f">{right}"], (a, b) in exact


GRAPH = "pattern string, instance string, seed boolean, n long"


def graph_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (pattern, instance, seed, n) of a task's texts, summed before they are shuffled."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [(), (), (), ()]
        seen.clear()
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["pattern", "instance", "seed", "n"])

    for b in batches:
        for i in range(b.num_rows):
            text = b.column(0)[i].as_py() or ""
            for _, _, token, patterns, seed in mentions(text, base_spans(text)):
                for p in patterns:
                    seen[p, key_of(token), seed] += 1
            if len(seen) > 100_000:
                yield flush()
    yield flush()


#: Rounds of scoring, the weight of the doubt in a pattern's score, and what a pattern needs in the end.
ROUNDS, DOUBT, CONFIDENCE, LEAST_SEEDS = 3, 2.0, 0.5, 3
#: A pattern without a shape admits every form, so this share of its own mentions must be seeds (doubt counted as above).
SEED_SHARE = 0.75
#: Share of an instance's mentions that kept patterns must vouch for before it becomes a seed.
PROMOTE = 0.5
#: So many patterns, the most frequent ones, are sent to every task; the others meet their mentions in a shuffle.
MOST_SENT = 100_000
#: Parts in which the documents of one text are joined, so that those of a frequent text do not gather in one task.
SALTS = 16


def scored(worth: DataFrame) -> DataFrame:
    """(pattern, score, seeds, others, share, n) of the graph's patterns, given what each edge's instance is worth."""
    out = worth.groupBy("pattern").agg(
        (F.sum(F.col("n") * F.col("worth")) / (F.sum("n") + DOUBT)).alias("score"),
        F.count_if("seed").alias("seeds"),
        F.count_if(~F.col("base")).alias("others"),
        (F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)) / (F.sum("n") + DOUBT)).alias("share"),
        F.sum("n").alias("n"),
    )
    return materialize(out)


def kept_of(score: DataFrame, confidence: float) -> DataFrame:
    """Patterns with high confidence and enough seeds; one without other instances has nothing to discover."""
    good = (F.col("score") >= confidence) & (F.col("seeds") >= LEAST_SEEDS) & (F.col("others") > 0)
    shaped = F.col("pattern").contains(" ") | F.col("pattern").startswith("=")
    return score.where(good & (shaped | (F.col("share") >= SEED_SHARE))).select("pattern", "score", "n")


def promoted(graph: DataFrame, kept: DataFrame) -> DataFrame:
    """(instance) of the graph's instances that are no seeds yet, but for which kept patterns vouch on two sides at
    least in PROMOTE of their mentions."""
    todo = graph.where("not seed").select("pattern", "instance", "n")
    vouched = join_frequent(todo, kept.select("pattern", F.lit(1).alias("kept")), "pattern").where("kept = 1")
    sides_ = vouched.groupBy("instance", F.substring("pattern", 1, 1).alias("side")).agg(F.max("n").alias("vouched"))
    # each mention has one shape
    all_ = todo.where(F.col("pattern").startswith("=")).groupBy("instance").agg(F.sum("n").alias("all"))
    strong = sides_.join(all_, "instance").where(F.col("vouched") >= PROMOTE * F.col("all"))
    return strong.groupBy("instance").count().where("count >= 2").select("instance")


def learn_patterns(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, score, n) of the high-confidence patterns, by iterated scoring of the pattern-instance graph.

    All documents are read. The score of a pattern is sum(n * worth) / (sum(n) + DOUBT) over its instances; a seed's
    worth is 1, another instance's the mean score of its patterns. Between rounds, instances that kept patterns vouch
    for become seeds. A pattern's own mentions alone decide whether it is kept; n counts them. All steps are grouped
    sums with partial aggregation and joins that broadcast frequent keys, so that no pattern or instance gathers in one
    task.
    """
    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(lambda it: freed(graph_rows(it)), GRAPH)
    graph = materialize(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")).withColumn("base", F.col("seed")))
    old, worth = [graph], graph.withColumn("worth", F.col("seed").cast("double"))
    for left in range(rounds - 1, -1, -1):
        score = scored(worth)
        old.append(score)
        if not left:
            break
        more = materialize(promoted(graph, kept_of(score, confidence)).withColumn("more", F.lit(1)))
        means = join_frequent(graph.where("not seed"), score.select("pattern", "score"), "pattern")
        means = materialize(means.groupBy("instance").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean")))
        raised = join_frequent(graph, means.join(more, "instance", "left"), "instance")
        raised = materialize(raised.withColumn("seed", F.col("seed") | F.coalesce(F.col("more") == 1, F.lit(False))).drop("more"))
        old += [more, means, raised]
        graph = raised.drop("mean")
        worth = raised.withColumn("worth", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0))))
    kept = materialize(kept_of(score, confidence))
    for df in old:
        remove(df)
    return kept


def sides(patterns: list[str], known: frozenset[str]) -> set[str]:
    """Which sides of a mention the known ones of its patterns vouch for, by their first characters."""
    return {p[0] for p in patterns if p in known}


def spans_of(text: str, known: frozenset[str], rare: frozenset[tuple[int, int]] = frozenset()) -> list[tuple[str, int, int]]:
    """Base spans, then what the patterns add: mentions for which two sides at least vouch, or which rare has."""
    base = base_spans(text)
    if not known and not rare:
        return base
    found, reach = [], 0
    for a, b, _, ps, seed in sorted(mentions(text, base), key=lambda m: (m[0], -m[1])):
        # of found spans inside one another, the longest
        if not seed and b > reach and (len(sides(ps, known)) >= 2 or (a, b) in rare):
            found.append((FOUND, a, b))
            reach = b
    return base + found


OPEN = "key string, start int, end int, side string, pattern string"


def open_rows(batches: Iterator[pa.RecordBatch], known: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Of batches (key, text), the mentions that the known patterns leave undecided: a row for each side known to vouch
    (pattern null), and one for each pattern that may yet vouch for another side."""
    kinds = {"key": pa.string(), "start": pa.int32(), "end": pa.int32(), "side": pa.string(), "pattern": pa.string()}
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        for i in range(batch.num_rows):
            key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""
            for a, b, _, patterns, seed in mentions(text, base_spans(text)):
                have = sides(patterns, known)
                if not seed and len(have) < 2:
                    rows += [(key, a, b, side, None) for side in have]
                    rows += [(key, a, b, p[0], p) for p in patterns if p[0] not in have]
            if len(rows) > 20_000:
                yield flush()
    yield flush()


def with_rare(docs: DataFrame, patterns: DataFrame | None) -> tuple[DataFrame, Broadcast]:
    """docs with the spans that only the less frequent patterns decide (column rare_), and the others, a broadcast set.

    Up to MOST_SENT patterns, all are sent and rare_ is null. Beyond, undecided mentions are joined to all patterns;
    an unsent pattern has at most 5 / MOST_SENT of the mentions. A text is known by its SHA-256.
    """
    patterns, context = learn_patterns(docs) if patterns is None else patterns, docs.sparkSession.sparkContext
    spans = "array<struct<start:int,end:int>>"
    if patterns.limit(MOST_SENT + 1).count() <= MOST_SENT:
        known = frozenset(r["pattern"] for r in patterns.select("pattern").collect())
        return docs.withColumn("rare_", F.lit(None).cast(spans)), context.broadcast(known)
    known = context.broadcast(frozenset(r["pattern"] for r in patterns.orderBy(F.desc("n"), "pattern").limit(MOST_SENT).select("pattern").collect()))
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
    rows = materialize(texts.mapInArrow(lambda it: freed(open_rows(it, known.value)), OPEN).distinct())
    vouched = rows.where("pattern is not null").join(patterns.select("pattern"), "pattern", "left_semi").select("key", "start", "end", "side")
    vouched = vouched.union(rows.where("pattern is null").select("key", "start", "end", "side")).distinct()
    found = vouched.groupBy("key", "start", "end").count().where("count >= 2")
    rare = found.groupBy(F.col("key").alias("key_")).agg(F.collect_list(F.struct("start", "end")).alias("rare_"))
    rare = materialize(rare.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    remove(rows)
    keyed = docs.withColumns({"key_": F.sha2("text", 256), "salt_": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    return keyed.join(rare, ["key_", "salt_"], "left").drop("key_", "salt_"), known


def pairs(rare: pa.Scalar) -> frozenset[tuple[int, int]]:
    return frozenset((r["start"], r["end"]) for r in rare.as_py() or ())


def find(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """docs (text, ...) with pii: array of (kind, start, end), the base kinds in order, then the found ones.

    patterns: of learn_patterns(docs) unless given. The most frequent ones are sent to every task, the others joined. A
    null or empty text has no spans; repeated rows get equal spans; an existing column pii is replaced, others are kept.
    """
    small_batches(docs.sparkSession)
    docs, known = with_rare(docs, patterns)
    kind = "array<struct<kind:string,start:int,end:int>>"
    to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(kind)
    def spans(text: pa.Array, rare: pa.Array) -> pa.Array:
        found = (spans_of(t.as_py() or "", known.value, pairs(r)) for t, r in zip(text, rare, strict=True))
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f] for f in found], to)

    return docs.drop("pii").withColumn("pii", spans("text", "rare_")).drop("rare_")


def mask(docs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """docs with every span of find() replaced in text by its kind in angle brackets; overlapping spans count once."""
    small_batches(docs.sparkSession)
    docs, known = with_rare(docs, patterns)

    def masked(text: str, rare: frozenset[tuple[int, int]]) -> str:
        out, free = [], 0
        for kind, a, b in sorted(spans_of(text, known.value, rare), key=lambda s: (s[1], -s[2])):
            if a >= free:
                out += [text[free:a], f"<{kind}>"]
            free = max(free, b)
        return "".join([*out, text[free:]])

    @F.arrow_udf("string")
    def mask_text(text: pa.Array, rare: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else masked(t, pairs(r)) for x, r in zip(text, rare, strict=True)], pa.string())

    return docs.withColumn("text", mask_text("text", "rare_")).drop("rare_")
