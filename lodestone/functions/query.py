"""Search conditions written as text, turned into a boolean column over a table's fields.

Two notations share one grammar of binary operators. In ``matches`` they are the words OR, RANK, AND and ANDNOT, from the
loosest to the tightest; in ``sp_matches`` the signs ``|`` and ``#`` (either), ``+`` (both) and ``!`` (without). In both,
``field:`` in front of a term or a parenthesis names the field that it is looked up in.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as fulltext

#: A field looks a term up: it gets the term and gives a condition.
Field = Callable[[str], Column]

_EITHER: Callable = lambda a, b: a | b
_BOTH: Callable = lambda a, b: a & b
_FIRST: Callable = lambda a, b: a
#: Operators by how tightly they bind. What follows RANK only adds to scores.
WORDS = {"OR": (1, _EITHER), "RANK": (2, _FIRST), "AND": (3, _BOTH), "ANDNOT": (4, fulltext.but_not)}
SIGNS = {"|": (1, _EITHER), "#": (2, _EITHER), "+": (3, _BOTH), "!": (4, fulltext.but_not)}

_TOKEN = re.compile(r"""\s*(?:(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<range>[\[(]\s*-?[\d.]*\s*,\s*-?[\d.]*\s*[\])])|(?P<sign>[()|#+!:])|(?P<word>[^\s()|#+!:"',]+))""")


def words_field(words: Column) -> Field:
    """A full-text field over an array of tokens: the tokens of a term must follow each other."""

    def look_up(term: str) -> Column:
        parts = [x for x in re.split(f"[ {re.escape(fulltext.BREAKS)}]+", term.lower()) if x]
        if not parts:
            raise ValueError(f"no word in {term!r}")
        return fulltext.term(words, parts[0]) if len(parts) == 1 else fulltext.phrase(words, *parts)

    return look_up


def value_field(value: Column) -> Field:
    """A field with one value: a term is compared with it, ``[a,b]`` and ``(a,b)`` are closed and open intervals."""

    def look_up(term: str) -> Column:
        interval = re.fullmatch(r"([\[(])\s*(-?[\d.]*)\s*,\s*(-?[\d.]*)\s*([\])])", term)
        if interval is None:
            return value.cast("string") == term
        opened, low, high, closed = interval.groups()
        return fulltext.number_range(value, float(low) if low else None, float(high) if high else None, opened == "[", closed == "]")

    return look_up


class _Reader:
    def __init__(self, query: str, fields: dict[str, Field], default: str | None, operators: dict):
        self.fields, self.operators, self.tokens, at = fields, operators, [], 0
        query = query.rstrip()
        while at < len(query):
            found = _TOKEN.match(query, at)
            if found is None:
                raise ValueError(f"can't read {query[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.signs = operators is SIGNS
        if not self.tokens:
            raise ValueError("an empty query")
        self.result = self.expression(0, default)
        if self.tokens:
            raise ValueError(f"unexpected {self.tokens[0][1]!r}")

    def next_is(self, *values: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] in ("sign", "word") and self.tokens[0][1] in values

    def expression(self, least: int, field: str | None) -> Column:
        if self.signs and self.next_is("+"):
            self.tokens.pop(0)
        left = self.operand(field)
        while self.next_is(*self.operators) and self.operators[self.tokens[0][1]][0] > least:
            sign = self.tokens.pop(0)[1]
            if self.signs and sign == "+" and (not self.tokens or self.next_is(")")):
                break
            bind, join = self.operators[sign]
            left = join(left, self.expression(bind, field))
        return left

    def operand(self, field: str | None) -> Column:
        if not self.tokens:
            raise ValueError("the query ends where a term is needed")
        kind, value = self.tokens.pop(0)
        if value == "(" and kind == "sign":
            inner = self.expression(0, field)
            if not self.next_is(")"):
                raise ValueError("a parenthesis isn't closed")
            self.tokens.pop(0)
            return inner
        if kind == "sign" or kind == "word" and value in self.operators:
            raise ValueError(f"unexpected {value!r}")
        if kind == "word" and self.next_is(":"):
            if value not in self.fields:
                raise ValueError(f"unknown field {value!r}")
            self.tokens.pop(0)
            return self.operand(value)
        if field is None:
            raise ValueError(f"{value!r} has no field to be looked up in")
        term = re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "quoted" else value
        return self.fields[field](term)


def matches(query: str, fields: dict[str, Field], default: str | None = None) -> Column:
    """The condition of a query such as ``title:spark AND (body:"a phrase" OR size:[10,20]) ANDNOT lang:de``."""
    return _Reader(query, fields, default, WORDS).result


def sp_matches(query: str, fields: dict[str, Field], default: str | None = None) -> Column:
    """The condition of a query such as ``+(title:spark|body:data)+size:[10,20]!lang:de``."""
    return _Reader(query, fields, default, SIGNS).result


def match_index(name: str, query: str, fields: dict[str, Field], any_of: bool = False) -> Column:
    """Look the words of a query text up in one index: all of them, or any of them."""
    if name not in fields:
        raise ValueError(f"unknown index {name!r}")
    words = query.split()
    if not words:
        raise ValueError("an empty query")
    return reduce(_EITHER if any_of else _BOTH, [fields[name](w) for w in words])
