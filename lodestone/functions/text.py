"""Tokens and full-text predicates. A predicate is a boolean expression over an array of tokens."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that separate words besides the space.
BREAKS = "\t\n\r.,;:!?|\"'()[]{}"


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-cased words between spaces and punctuation, in order."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[ {re.escape(BREAKS)}]+"), "")
    return reduce(F.array_remove, stop_words, found)


def whitespace_tokens(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), " ")


def prefixes(word: Column) -> Column:
    """Every prefix of a word."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))


def suffix_prefixes(word: Column) -> Column:
    """Every suffix of a word, so that a prefix search over them finds infixes."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, n, F.length(word)))


def word_ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def term(words: Column, word: str) -> Column:
    return F.array_contains(words, word)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def but_not(condition: Column, without: Column) -> Column:
    return condition & ~without


def at_least(n: int, *conditions: Column) -> Column:
    """Weak AND: at least ``n`` of the conditions, all of them if there are fewer."""
    met = reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions])
    return met >= min(n, len(conditions))


def phrase(words: Column, *parts: str) -> Column:
    """Whether the parts follow each other. Spaces around both keep words whole, and one search covers all places."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(parts)} "))


def number_range(value: Column, low=None, high=None, low_in: bool = True, high_in: bool = True) -> Column:
    """A point or bounded interval with inclusive or open ends."""
    bounds = []
    if low is not None:
        bounds.append(value >= low if low_in else value > low)
    if high is not None:
        bounds.append(value <= high if high_in else value < high)
    return all_of(*bounds) if bounds else value.isNotNull()


def boosted(first: Column, *boosts: tuple[Column, float]) -> tuple[Column, Column]:
    """The filter and the score of a rank query: later conditions only add to the score."""
    score = reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(0.0) for c, w in boosts], F.lit(0.0))
    return first, score
