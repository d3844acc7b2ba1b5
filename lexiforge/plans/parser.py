"""The query language: a bag of words, "an exact phrase", or phrases joined by AND, OR, NOT.

Words outside quotes are a bag whatever they are; AND, OR and NOT only act between quoted phrases. Several operators
apply from left to right. A missing closing quote is tolerated, and a phrase of fewer than two kept words is a bag.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.text import kept_tokens


@dataclass(frozen=True)
class Bag:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    kind: str
    left: Bag | Phrase | Both
    right: Bag | Phrase | Both


Query = Bag | Phrase | Both


def analyse(text: str) -> tuple[str, ...]:
    """Kept tokens of a query, in order and with repeats, as documents are analysed (before stemming)."""
    return tuple(kept_tokens(text))


def phrase(text: str) -> Query:
    words = analyse(text)
    return Phrase(words) if len(words) > 1 else Bag(words)


def parse(query: str) -> Query:
    query = query.strip()
    if not query.startswith('"'):
        return Bag(analyse(query))
    parts = re.split(r'"\s*(AND|OR|NOT)\s*(?=")', query)
    out = phrase(parts[0].strip('"'))
    for kind, text in zip(parts[1::2], parts[2::2], strict=True):
        out = Both(kind, out, phrase(text.strip('"')))
    return out


def words_of(q: Query) -> tuple[str, ...]:
    """All words of a query, left before right, repeats kept."""
    return words_of(q.left) + words_of(q.right) if isinstance(q, Both) else q.words
