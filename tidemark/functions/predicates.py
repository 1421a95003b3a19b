"""Rules as data: a predicate object becomes one nullable boolean column.

TRUE and FALSE are known outcomes, NULL is unknown; "all" and "any" are then
simply AND and OR.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cells

COMPARE: dict[str, Callable] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}
TEMPORAL = {"before": "lt", "after": "gt", "on_or_before": "le", "on_or_after": "ge"}
MEMBERS = {"in", "not_in"}
DEEPEST = 8

#: A column by its name, with its type.
Lookup = Callable[[str], tuple[Column, T.DataType]]


def _constant(value: object) -> None:
    if isinstance(value, bool):
        raise ValueError("A numeric rule can't be compared with a boolean.")
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        number = math.nan
    if not math.isfinite(number):
        raise ValueError(f"A numeric rule needs finite constants, not {value!r}.")


def validate(rule: object, depth: int = 0) -> None:
    """Raise ValueError unless ``rule`` is a predicate; runs no job."""
    if not isinstance(rule, dict):
        raise ValueError("A predicate must be an object.")
    if depth > DEEPEST:
        raise ValueError(f"Predicates may be nested {DEEPEST} levels deep.")
    joined = [k for k in ("all", "any") if k in rule]
    if joined:
        parts = rule[joined[0]]
        if len(rule) != 1 or not isinstance(parts, list) or not parts:
            raise ValueError(f"{joined[0]!r} takes a nonempty list and nothing beside it.")
        for part in parts:
            validate(part, depth + 1)
        return
    op, kind = rule.get("op"), rule.get("kind", "numeric")
    problems = {
        "A predicate names its column.": not isinstance(rule.get("column"), str) or not rule["column"],
        f"There is no predicate operator {op!r}.": not isinstance(op, str) or op not in COMPARE.keys() | TEMPORAL.keys() | MEMBERS,
        "A predicate has fields it can't have.": not rule.keys() <= {"column", "op", "value", "other_column", "kind"},
        "A predicate compares with either a value or another column.": ("value" in rule) is ("other_column" in rule),
        "other_column is a column name.": "other_column" in rule and not (isinstance(rule["other_column"], str) and rule["other_column"]),
        "kind is numeric or string.": kind not in ("numeric", "string"),
    }
    for message, wrong in problems.items():
        if wrong:
            raise ValueError(message)
    value = rule.get("value")
    if op in MEMBERS and (not isinstance(value, list) or not value):
        raise ValueError("in and not_in take a nonempty list of values.")
    if op not in MEMBERS and isinstance(value, list):
        raise ValueError("Only in and not_in take a list.")
    if "value" in rule:
        for v in value if isinstance(value, list) else [value]:
            if not isinstance(v, (str, int, float)):
                raise ValueError("Predicate values are strings or numbers.")
            if kind == "numeric" and op not in TEMPORAL:
                _constant(v)


def columns(rule: dict) -> set[str]:
    """Names of all columns a predicate refers to."""
    parts = rule.get("all") or rule.get("any")
    if parts:
        return set().union(*map(columns, parts))
    return {rule[k] for k in ("column", "other_column") if k in rule}


def compile_rule(rule: dict, lookup: Lookup) -> Column:
    """The predicate as a column: TRUE, FALSE, or NULL where the evidence is missing."""
    for word, joined in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if word in rule:
            return reduce(joined, [compile_rule(p, lookup) for p in rule[word]])
    op, numeric = rule["op"], rule.get("kind", "numeric") == "numeric"
    left, left_kind = lookup(rule["column"])
    known = ~cells.missing(left, left_kind)
    if op in MEMBERS:
        choices = [float(v) if numeric else str(v) for v in rule["value"]]
        cell = cells.number(left, left_kind, booleans=True) if numeric else cells.text(left, left_kind)
        inside = cell.isin(choices)
        return F.when(known, inside if op == "in" else ~inside)
    if "other_column" in rule:
        right, right_kind = lookup(rule["other_column"])
        known = known & ~cells.missing(right, right_kind)
    else:
        value = rule["value"]
        right_kind = T.StringType() if isinstance(value, str) else T.BooleanType() if isinstance(value, bool) else T.DoubleType()
        right = F.lit(float(value)) if isinstance(right_kind, T.DoubleType) and numeric else F.lit(str(value))
        if not numeric and op not in TEMPORAL:
            right_kind = T.StringType()
        known = known & ~cells.missing(right, right_kind)
    if op in TEMPORAL:
        absolute = [cells.instant(c, k) for c, k in ((left, left_kind), (right, right_kind))]
        return F.when(known, COMPARE[TEMPORAL[op]](*absolute))
    if numeric:
        return F.when(known, COMPARE[op](cells.number(left, left_kind, booleans=True), cells.number(right, right_kind, booleans=True)))
    return F.when(known, COMPARE[op](cells.text(left, left_kind), cells.text(right, right_kind)))
