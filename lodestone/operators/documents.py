"""Document processing before a table is built: filters on messages, field processors and raw-document conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_in(field: Column, values: str, optional: bool = False) -> Column:
    """Membership in ``a|b``; a missing field passes only an optional filter."""
    return F.coalesce(field.isin(values.split("|")), F.lit(optional))


def field_contains(field: Column, values: str) -> Column:
    """Whether the field holds any of ``a|b`` as a substring; a missing field doesn't."""
    found = F.lit(False)
    for value in values.split("|"):
        found = found | F.contains(field, F.lit(value))
    return F.coalesce(found, F.lit(False))


def in_hash_range(hashed: Column, low: int, high: int, payload_mask: Column | None = None, mask: int = 0, result: int = 0) -> Column:
    """Messages whose hash lies in [low, high] and whose mask byte agrees."""
    own = hashed.between(low, high)
    return own if payload_mask is None else own & (payload_mask.bitwiseAND(F.lit(mask)) == result)


def topic_hash(*keys: Column, width: int = 65536) -> Column:
    """The place of a key, or of several together, among ``width``; the order of keys counts."""
    return F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")


def copied(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    return rows.withColumns({to: F.col(source) for source, to in fields.items()})


def with_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fill fields that are null or empty."""
    return rows.withColumns({c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def with_build_type(rows: DataFrame, key: str, value: str, out: str = "realtime") -> DataFrame:
    return rows.withColumn(out, ~F.coalesce(F.col(key) == value, F.lit(False)))


def alive(rows: DataFrame, stamp: str, seconds: int, now: Column) -> DataFrame:
    """Rows whose time to live isn't over at ``now``."""
    return rows.where(F.col(stamp) + F.make_interval(secs=F.lit(seconds)) > now)


def hash_percent(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """A fixed share of the keys, the same each time."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(100)) < percent)


def deduplicated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def routed(rows: DataFrame, chains: dict[str, Column], out: str = "chain", default: str = "default") -> DataFrame:
    """Name the first chain whose condition fits."""
    chosen = None
    for name, condition in chains.items():
        chosen = F.when(condition, name) if chosen is None else chosen.when(condition, name)
    return rows.withColumn(out, F.lit(default) if chosen is None else chosen.otherwise(default))


def changed_fields(old: DataFrame, new: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Names of the fields that differ between two versions of each row that both have."""
    fields = [c for c in new.columns if c != key and c not in ignore]
    before = old.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in fields]))
    return new.join(before, key).select(key, names.alias("changed"))


def decoded(data: Column, charset: str) -> Column:
    """Text of bytes in a charset."""
    return F.decode(data, charset)


def encoded(text: Column, charset: str) -> Column:
    return F.encode(text, charset)


def from_base64(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Binary fields that a feed carries as text."""
    return rows.withColumns({f: F.unbase64(f) for f in fields})


def line_fields(line: Column, names: list[str], sep: str) -> list[Column]:
    """The fields of a line, by place; those that it lacks are null."""
    parts = F.split(line, rf"\Q{sep}\E")
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def flip_halfwidth(text: Column) -> Column:
    """Full-width digits and letters to their plain forms, and lower case."""
    wide = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    return F.lower(F.translate(text, wide, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
