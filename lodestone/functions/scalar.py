"""Scalar predicates and functions of the search dialect, as expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates alternatives unless a call says otherwise.
SEPARATOR = "|"


def terms_of(terms: str, sep: str = SEPARATOR) -> list[str]:
    """The alternatives of a list literal; empty ones don't count."""
    return [t for t in terms.split(sep) if t]


def contain(values: Column, terms: str, sep: str = SEPARATOR) -> Column:
    """Whether an array holds any of the terms."""
    return F.arrays_overlap(values, F.array(*[F.lit(t) for t in terms_of(terms, sep)]).cast("array<string>"))


def ha_in(value: Column, terms: str, sep: str = SEPARATOR) -> Column:
    """Whether a scalar is one of the terms; parquet scans get it as an IN filter."""
    return value.isin(terms_of(terms, sep))


def pidvid_contain(pairs: Column, terms: str) -> Column:
    """Whether an array of ``pid:vid`` strings holds any of the pairs."""
    return contain(pairs, terms)


def kv_extract_match(pairs: Column, sep: str, key: str, value: str | None = None) -> Column:
    """Whether ``k:v`` pairs held in one string have the key, and one of the values if any are given."""
    held = F.str_to_map(pairs, F.lit((sep or SEPARATOR)[0].replace("|", "\\|")), F.lit(":"))
    found = F.element_at(held, key)
    return F.map_contains_key(held, key) if value is None else F.coalesce(found.isin(terms_of(value)), F.lit(False))


def in_string(value: Column, members: str, sep: str = ",") -> Column:
    return value.cast("string").isin(members.split(sep))


def notin_string(value: Column, members: str, sep: str = ",") -> Column:
    return ~in_string(value, members, sep)


def sum_of(*columns: Column) -> Column:
    """Row-wise sum."""
    return reduce(add, columns)


def log_of(base: Column, value: Column) -> Column:
    return F.ln(value) / F.ln(base)


def current_time_in_seconds() -> Column:
    """Seconds since 1970; one value for a whole query."""
    return F.unix_timestamp()


def strcat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def multi_value(text: Column, sep: str = "\x1d") -> Column:
    """The values of a multi-value field; an empty field has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, sep))


def sort_keys(spec: str) -> list[Column]:
    """Sort keys from ``+a,-b``: a minus sorts from the top, a plus or no sign from the bottom.

    ``t:+a,-b`` names fields of the table with the alias ``t``.
    """
    keys = []
    owner, mark, rest = spec.partition(":")
    for item in (rest if mark else spec).split(","):
        name = f"{owner.strip()}." * bool(mark) + item.strip().lstrip("+-")
        keys.append(F.col(name).desc_nulls_last() if item.strip().startswith("-") else F.col(name).asc_nulls_first())
    return keys


def sub_count(children: Column) -> Column:
    return F.size(children)


def sub_sum(children: Column, value) -> Column:
    return F.aggregate(F.transform(children, value), F.lit(0.0), lambda a, x: a + x.cast("double"))


def sub_min(children: Column, value) -> Column:
    return F.array_min(F.transform(children, value))


def sub_max(children: Column, value) -> Column:
    return F.array_max(F.transform(children, value))


def sub_first(children: Column, value) -> Column:
    return F.get(F.transform(children, value), 0)


def sub_join(children: Column, value, sep: str = " ") -> Column:
    return F.array_join(F.transform(children, lambda c: value(c).cast("string")), sep)


def distance_km(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat), F.radians(F.lit(to_lat))
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(to_lon) - lon) / 2), 2)
    return F.asin(F.sqrt(F.least(half, F.lit(1.0)))) * (2 * 6371.0088)


def in_polygon(lon: Column, lat: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting over the edges of a polygon, one expression for all of them."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(straddles & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1
