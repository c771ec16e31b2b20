"""String, regex, label and map helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import as_column

# fixed values: roman numerals of oxidation states
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8}


def shorten(column, width: int) -> Column:
    """cut to `width` characters with an ellipsis."""
    c = as_column(column)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def without_part(column, separator: str, prefix: str) -> Column:
    """split, drop the parts with a prefix, join again."""
    parts = F.filter(F.split(as_column(column), separator), lambda p: ~p.startswith(prefix))
    return F.array_join(parts, separator.replace("\\", ""))


def _roman(text: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), text)


def roman_at_end(column) -> Column:
    """value of a roman numeral at the end of the text, else 0."""
    return F.coalesce(_roman(F.upper(F.regexp_extract(as_column(column), r"(?i)\b([IVX]+)$", 1))), F.lit(0))


def roman_in_parentheses(column, fallback: Mapping[str, int] | None = None) -> Column:
    """value of a roman numeral in parentheses, else a fallback by text, else 0."""
    c = as_column(column)
    found = _roman(F.upper(F.regexp_extract(c, r"(?i)\(([IVX]+)\)", 1)))
    return F.coalesce(found, lookup(c, fallback or {}), F.lit(0))


def lookup(column, mapping: Mapping, default=None) -> Column:
    """literal map lookup with a default."""
    if not mapping:
        return F.lit(default)
    found = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), as_column(column))
    return found if default is None else F.coalesce(found, F.lit(default))


def first_number(column, prefix: str) -> Column:
    """the number after a prefix, null when absent."""
    return F.regexp_extract(as_column(column), f"{prefix}(\\d+)", 1).try_cast("int")


def parse_label(column) -> Column:
    """struct(is_batch, acq, surrogate, seed) from 'acq|surrogate|seed=N' or 'batch|acq|strategy'."""
    parts = F.split(as_column(column), r"\|")
    batch = F.get(parts, F.lit(0)) == "batch"
    plain = F.filter(parts, lambda p: ~p.rlike(r"^seed=\d+$"))
    seeds = F.filter(parts, lambda p: p.rlike(r"^seed=\d+$"))
    seed = F.substring(F.get(seeds, F.size(seeds) - 1), 6, 20).try_cast("int")
    return F.struct(
        batch.alias("is_batch"),
        F.when(batch, F.get(parts, F.lit(1))).otherwise(F.get(plain, F.lit(0))).alias("acq"),
        F.when(~batch, F.get(plain, F.lit(1))).alias("surrogate"),
        F.when(~batch, seed).alias("seed"),
    )


def composite_key(columns: Sequence, separator: str = ".", suffix: str = ">>") -> Column:
    """present parts joined, with a suffix; null when no part is present. Each part may be a list of preferences."""
    parts = []
    for c in columns:
        options = c if isinstance(c, (list, tuple)) else [c]
        parts.append(F.coalesce(*[F.nullif(F.trim(as_column(o).cast("string")), F.lit("")) for o in options]))
    joined = F.concat_ws(separator, *parts)
    return F.when(joined != "", F.concat(joined, F.lit(suffix)))


def first_match(column, table: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """label of the first pattern contained in the text, in table order."""
    c = as_column(column)
    return F.coalesce(*[F.when(c.contains(pattern), F.lit(label)) for pattern, label in table], F.lit(default))
