"""Expression builders.

Everything here returns a ``Column`` made of built-in functions so it stays inside
whole-stage codegen. pandas semantics that the operators reproduce:

* missing = null, or NaN for floating columns;
* a blank string is one that is empty after trimming (regex ``^\\s*$``);
* ``to_numeric(errors="coerce")`` = ``strict_number`` (ANSI-safe);
* NaN never satisfies a bound check (Spark orders NaN above every number, so guard).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK_RE = r"^\s*$"


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_missing(c: str | Column, dt: T.DataType | None = None) -> Column:
    """null, or NaN when the column is floating (pandas ``isnull``)."""
    col = F.col(c) if isinstance(c, str) else c
    if dt is None or is_floating(dt):
        if dt is None:
            return col.isNull()
        return col.isNull() | F.isnan(col)
    return col.isNull()


def is_blank(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.rlike(BLANK_RE), F.lit(False))


def clean_number(c: str | Column, dt: T.DataType | None = None) -> Column:
    """A numeric value with missing (null or NaN) mapped to null, so aggregates skip it."""
    col = F.col(c) if isinstance(c, str) else c
    if dt is not None and not is_numeric(dt):
        col = strict_number(col) if isinstance(dt, T.StringType) else col.try_cast("double")
    elif dt is not None and not is_floating(dt):
        return col.cast("double")
    return F.when(~F.isnan(col), col)


def safe_div(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """a / b, with ``zero`` when b is 0 or null (sklearn ``zero_division=0``)."""
    res = F.when((b.isNotNull()) & (b != 0), a / b)
    return res.otherwise(F.lit(zero)) if zero is not None else res


def r6(c: Column, digits: int = 6) -> Column:
    """Round half away from zero at ``digits`` decimals on the double itself: y = x * 10^d,
    sign(y) * floor(|y| + 0.5) / 10^d. Stays in codegen (``F.round`` on a double goes through a
    BigDecimal per value) and is the same IEEE arithmetic SQL engines use for DOUBLE rounding.
    NaN, infinities and values already integral at that scale pass through unchanged."""
    m = float(10 ** digits)
    y = c * F.lit(m)
    return F.when(F.abs(y) < F.lit(float(2 ** 52)), F.signum(y) * F.floor(F.abs(y) + F.lit(0.5)) / F.lit(m)).otherwise(c)


#: numbers that text may hold: plain decimals, infinities and NaN. A cast alone also takes
#: type suffixes and hexadecimal forms.
NUMBER_RE = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def strict_number(col: Column) -> Column:
    """Text as a double; null where it is no plain number."""
    return F.when(col.rlike(NUMBER_RE), col.try_cast("double"))


def hash_order_key(seed: int | str, key: str | Column) -> Column:
    """Seeded, engine-independent row order: ``md5(seed || '|' || key)`` as 32 hex chars."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col.cast("string")))


def sanitize(name: str) -> str:
    """Column-name safe text: lower case, runs of other characters -> '_'."""
    s = re.sub(r"[^0-9a-zA-Z]+", "_", str(name)).strip("_").lower()
    return s or "blank"


def feature_structs(fields: Iterable[tuple[str, dict[str, Column]]]) -> Column:
    """array(struct(feature, stats...)) — used with ``inline`` to turn one wide aggregate row
    into one row per feature without a second scan."""
    structs = []
    for name, stats in fields:
        structs.append(F.struct(F.lit(name).alias("feature"), *[v.alias(k) for k, v in stats.items()]))
    return F.array(*structs)
