"""Column expressions for single cells: missing, numeric, text, absolute time.

Everything here is a built-in expression, so it stays in generated code and
columns it doesn't touch are pruned from the scan.  A value that can't be judged
is NULL, so that SQL's three-valued logic carries "unknown" through rules.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Unicode has it, and the four ASCII separators.
BLANK = r"[\s\x1c-\x1f]"
NUMBER = r"(?i)\A\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*\z"
ABSOLUTE = r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}(?::?\d{2})?)?)?\z"

Kind = T.DataType
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def missing(c: Column, kind: Kind) -> Column:
    """NULL, NaN, or a string of white space only; infinity isn't missing."""
    if isinstance(kind, T.StringType):
        return c.isNull() | F.coalesce(c.rlike(rf"(?U)\A{BLANK}*\z"), F.lit(False))
    if isinstance(kind, FLOATING):
        return c.isNull() | F.coalesce(F.isnan(c), F.lit(False))
    return c.isNull()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def number(c: Column, kind: Kind, name: str = "", booleans: bool = False) -> Column:
    """The cell as a finite double, NULL for anything else.

    A boolean column isn't a measurement and raises, unless ``booleans`` asks for
    1 and 0; a temporal column always raises.
    """
    if isinstance(kind, T.BooleanType) and not booleans:
        raise ValueError(f"Column {name!r} is boolean; booleans are not measurements.")
    if isinstance(kind, TEMPORAL):
        raise ValueError(f"Column {name!r} is temporal, not numeric.")
    if isinstance(kind, T.StringType):
        value = F.when(c.rlike(NUMBER), c.try_cast("double"))
    elif isinstance(kind, T.BooleanType):
        value = c.cast("int").cast("double")
    elif isinstance(kind, T.NumericType):
        value = c.cast("double")
    else:
        value = F.lit(None).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def text(c: Column, kind: Kind) -> Column:
    """The cell's text; booleans as True and False."""
    return F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")


def key(c: Column, kind: Kind) -> Column:
    """The cell as a grouping key: NULL and NaN are one key, all other values keep their own."""
    return F.when(~F.isnan(c), c) if isinstance(kind, FLOATING) else c


def instant(c: Column, kind: Kind) -> Column:
    """An absolute point in time, or NULL.

    Times without a zone are UTC, whatever the session's zone.  Strings must be
    ISO dates or timestamps; named zones and relative words are not accepted.
    """
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, T.DateType | T.TimestampNTZType):
        return _instant(c.cast("string"))
    if isinstance(kind, T.StringType):
        return _instant(c)
    return F.lit(None).cast("timestamp")


def _instant(c: Column) -> Column:
    whole = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00"))).otherwise(F.regexp_replace(c, r"\s+(Z|[+-]\d{2}:?\d{0,2})\z", "$1"))
    zoned = whole.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)\z") & (F.length(c) > 10)
    full = F.regexp_replace(F.regexp_replace(whole, r"([+-]\d{2})\z", "$1:00"), r"([+-]\d{2})(\d{2})\z", "$1:$2")
    whole = F.when(zoned, full).otherwise(F.concat(whole, F.lit("Z")))
    return F.when(c.rlike(ABSOLUTE), F.regexp_replace(whole, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2").try_cast("timestamp"))


def python_pattern(pattern: str) -> str | None:
    """The pattern for Java, or None where Python's meaning may differ from Java's."""
    risky = re.search(r"\(\?P|\(\?[aiLmsux]|\(\?\(|\\Z|\\[NuUpP]|\[\[|&&|\\[bBwWdDsS]", pattern)
    unicode_classes = {r"\d", r"\s", r"\w", r"\D", r"\S", r"\W", r"\b", r"\B"}
    if risky and risky.group() not in unicode_classes:
        return None
    # Unix lines: the only line end that "." stops at and "$" looks behind is \n, as in Python
    flag = "(?dU)" if re.search(r"\\[bBwWdDsS]", pattern) else "(?d)"
    return rf"{flag}\A(?:{pattern})\z"


def full_match(c: Column, pattern: str) -> Column:
    """Whether a Python regular expression matches the whole string; Arrow batches where Java would read it differently."""
    own = python_pattern(pattern)
    if own is not None:
        return c.rlike(own)

    @F.pandas_udf("boolean")
    def matches(s: pd.Series) -> pd.Series:
        find = re.compile(pattern).fullmatch
        return s.map(lambda x: None if x is None else find(x) is not None).astype("boolean")

    return matches(c)
