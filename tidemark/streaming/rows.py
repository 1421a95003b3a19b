"""Row-local checks on a stream.

Checks that depend on one row alone are column expressions, so they run
unchanged on a streaming DataFrame, without state: every row gets the codes it
violates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cells, predicates
from tidemark.plans.config import AuditConfig


def violations(stream: DataFrame, config: AuditConfig, to: str = "violations") -> DataFrame:
    """``stream`` (a stream or a table) with an array of "code:column" or "code:rule name" as ``to``."""
    kinds = {f.name: f.dataType for f in stream.schema.fields}

    def lookup(name: str):
        if name not in kinds:
            raise ValueError(f"Missing required columns: {[name]}")
        return F.col(f"`{name}`"), kinds[name]

    marks: list[Column] = []

    def mark(code: str, what: str, wrong: Column) -> None:
        marks.append(F.when(wrong, F.lit(f"{code}:{what}")))

    if config.check_missing:
        for name in kinds:
            mark("missing_values", name, cells.missing(*lookup(name)))
    for name in dict.fromkeys([*config.bounds, *config.sparse_bins, *config.numeric_columns]):
        mark("invalid_numeric", name, cells.number(*lookup(name), name).isNull())
    for name, (lower, upper) in config.bounds.items():
        x = cells.number(*lookup(name), name)
        if lower is not None:
            mark("out_of_bounds", name, x < float(lower))
        if upper is not None:
            mark("out_of_bounds", name, x > float(upper))
    for rule in config.rules:
        when = predicates.compile_rule(rule["when"], lookup) if "when" in rule else F.lit(True)
        holds = predicates.compile_rule(rule["assert"], lookup)
        mark("constraint_violation", rule["name"], when & ~holds)
        mark("constraint_not_evaluable", rule["name"], when.isNull() | (when & holds.isNull()))
    found = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return stream.withColumn(to, found)
