"""Text expressions."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: Column | str) -> Column:
    """Trim every Unicode space, U+00A0 included, which ``trim`` leaves."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def name_key(c: Column | str) -> Column:
    """Spelling-insensitive key of a name."""
    return F.lower(F.regexp_replace(trim_unicode(c), r"(?U)\s+", " "))


def short_name(c: Column | str) -> Column:
    return F.split_part(as_column(c), F.lit(","), F.lit(1))


def ordinal(c: Column | str) -> Column:
    n = as_column(c).cast("bigint")
    suffix = (
        F.when((n % 100).between(11, 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def _settled(x: Column) -> Column:
    """Move half-way values away from zero, whatever the order of summation was."""
    return F.round(x, 8) + F.signum(x) * F.lit(1e-9)


def fixed(c: Column | str, digits: int = 2, signed: bool = False, grouped: bool = False) -> Column:
    flags = ("+" if signed else "") + ("," if grouped else "")
    x = as_column(c).cast("double")
    return F.when(x.isNotNull(), F.format_string(f"%{flags}.{digits}f", _settled(x)))


def percent(c: Column | str, digits: int = 0, signed: bool = False) -> Column:
    """A share as a percentage: 0.44 becomes ``44%``."""
    return F.concat(fixed(as_column(c) * 100, digits, signed), F.lit("%"))


def map_labels(c: Column | str, labels: Mapping[str, str], default: Column | None = None) -> Column:
    """Labels of a small fixed map; the key itself, or ``default``, where it has none."""
    key = as_column(c)
    chain = None
    for code, label in labels.items():
        chain = F.when(key == code, label) if chain is None else chain.when(key == code, label)
    return chain.otherwise(default if default is not None else F.lit(None).cast("string"))


def render(template: str, **values: Column | str | int) -> Column:
    """Fill ``{name}`` placeholders with columns or plain values; NULL if a column is."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            value = values[field]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)
