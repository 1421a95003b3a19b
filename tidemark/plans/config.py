"""What to check and how to split, as plain JSON-compatible objects.

Each field is checked by a small validator named in a table; everything is
settled on the driver before any job runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from tidemark.functions import predicates

SEVERITIES = ("error", "warning", "info")
STRATEGIES = ("composition", "scaffold", "laboratory", "time", "extrapolation")
# Fixed value: how an absolute date or time begins.
ISO_START = re.compile(r"\d{4}-\d{2}-\d{2}(?:T| |$)")


def is_number(x: object) -> bool:
    """A finite int or float that isn't a boolean."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return False
    try:
        return math.isfinite(x)
    except OverflowError:
        return False


def _fail_unless(ok: object, message: str) -> None:
    if not ok:
        raise ValueError(message)


def check_names(value: object, what: str) -> None:
    _fail_unless(isinstance(value, (list, tuple)) and all(isinstance(x, str) and x for x in value), f"{what} must be a list of column names.")
    _fail_unless(len(set(value)) == len(value), f"{what} names a column twice.")


def _name(value: object, what: str) -> None:
    _fail_unless(value is None or (isinstance(value, str) and value), f"{what} must be a column name.")


def _flag(value: object, what: str) -> None:
    _fail_unless(isinstance(value, bool), f"{what} must be true or false.")


def _count(value: object, what: str) -> None:
    _fail_unless(isinstance(value, int) and not isinstance(value, bool) and value > 0, f"{what} must be a whole number from 1 on.")


def _not_negative(value: object, what: str) -> None:
    _fail_unless(is_number(value) and value >= 0, f"{what} must be a finite number from 0 on.")


def _share(value: object, what: str) -> None:
    _fail_unless(is_number(value) and 0 < value <= 1, f"{what} must lie above 0 and be at most 1.")


def _table(check: Callable[[str, object], None]) -> Callable[[object, str], None]:
    def run(value: object, what: str) -> None:
        _fail_unless(isinstance(value, dict), f"{what} must be an object.")
        check_names(list(value), what)
        for k, v in value.items():
            check(k, v)

    return run


def _limits(column: str, pair: object) -> None:
    ok = isinstance(pair, (list, tuple)) and len(pair) == 2 and any(x is not None for x in pair)
    _fail_unless(ok and all(x is None or is_number(x) for x in pair), f"Bounds of {column!r} are a pair [lower, upper] of finite numbers, one of which may be null.")
    _fail_unless(None in pair or pair[0] <= pair[1], f"Bounds of {column!r} are the wrong way round.")


def _unit(column: str, rule: object) -> None:
    _fail_unless(isinstance(rule, dict) and rule.keys() == {"column", "expected"}, f"The unit of {column!r} takes column and expected.")
    _fail_unless(all(isinstance(x, str) and x.strip() for x in rule.values()), f"The unit of {column!r} has a blank entry.")


def _edges(column: str, edges: object) -> None:
    _fail_unless(isinstance(edges, (list, tuple)) and len(edges) > 1 and all(map(is_number, edges)), f"Bins of {column!r} need two or more finite edges.")
    _fail_unless(all(a < b for a, b in zip(edges, edges[1:], strict=False)), f"Bin edges of {column!r} must rise.")


def _tolerance(column: str, value: object) -> None:
    _not_negative(value, f"The tolerance of {column!r}")


def _scale(column: str, value: object) -> None:
    _fail_unless(is_number(value) and value > 0, f"The scale of {column!r} must be above 0.")


def _pattern(column: str, value: object) -> None:
    _fail_unless(isinstance(value, str) and len(value) <= 256, f"The pattern of {column!r} must be text of at most 256 characters.")
    try:
        re.compile(value)
    except re.error as e:
        raise ValueError(f"The pattern of {column!r} isn't a regular expression.") from e


def _alias(label: str, value: object) -> None:
    _fail_unless(isinstance(value, str) and value.strip(), f"The alias of unit {label!r} must name a unit.")


def _compositions(value: object, what: str) -> None:
    _fail_unless(isinstance(value, list), f"{what} must be a list.")
    for part in value:
        _fail_unless(isinstance(part, dict) and "columns" in part and part.keys() <= {"columns", "total", "tolerance"}, "A composition has columns, and may have total and tolerance.")
        check_names(part["columns"], "columns of a composition")
        _fail_unless(part["columns"], "A composition has no columns.")
        _not_negative(part.get("tolerance", 0), "tolerance of a composition")
        _fail_unless(is_number(part.get("total", 100)) and part.get("total", 100) > 0, "total of a composition must be above 0.")


def _rules(value: object, what: str) -> None:
    _fail_unless(isinstance(value, list), f"{what} must be a list.")
    for rule in value:
        _fail_unless(isinstance(rule, dict) and rule.keys() <= {"name", "when", "assert", "severity", "action"}, "A rule has fields it can't have.")
        _fail_unless(isinstance(rule.get("name"), str) and rule["name"] and "assert" in rule, "A rule needs a name and an assert.")
        _fail_unless(rule.get("severity", "error") in SEVERITIES, f"A rule's severity is one of {', '.join(SEVERITIES)}.")
        _fail_unless(isinstance(rule.get("action", ""), str), "A rule's action is text.")
        for part in ("when", "assert"):
            if part in rule:
                predicates.validate(rule[part])


@dataclass
class AuditConfig:
    duplicate_columns: list[str] | None = None
    group_columns: list[str] = field(default_factory=list)
    split_column: str | None = None
    bounds: dict[str, list] = field(default_factory=dict)
    units: dict[str, dict[str, str]] = field(default_factory=dict)
    provenance_columns: list[str] = field(default_factory=list)
    sparse_bins: dict[str, list] = field(default_factory=dict)
    min_bin_count: int = 3
    feature_columns: list[str] = field(default_factory=list)
    unavailable_features: list[str] = field(default_factory=list)
    target_column: str | None = None
    check_missing: bool = True
    numeric_columns: list[str] = field(default_factory=list)
    identity_columns: list[str] = field(default_factory=list)
    conflict_columns: list[str] = field(default_factory=list)
    conflict_tolerance: float = 0.0
    identifier_columns: list[str] = field(default_factory=list)
    correlation_threshold: float = 0.995
    unit_aliases: dict[str, str] = field(default_factory=dict)
    compositions: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    near_duplicates: dict[str, float] = field(default_factory=dict)
    smiles_column: str | None = None
    molecular_similarity: float | None = None
    density_columns: list[str] = field(default_factory=list)
    density_scales: dict[str, float] = field(default_factory=dict)
    density_radius: float = 1.0
    min_neighbors: int = 3
    max_pair_comparisons: int = 2_000_000
    provenance_patterns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        for names, check in _AUDIT_CHECKS.items():
            for name in names.split():
                check(getattr(self, name), name)
        if self.duplicate_columns is not None:
            check_names(self.duplicate_columns, "duplicate_columns")
            _fail_unless(self.duplicate_columns, "duplicate_columns is empty.")
        if self.split_column is not None:
            for name in ("duplicate_columns", "group_columns"):
                _fail_unless(self.split_column not in (getattr(self, name) or []), f"{name} must leave out the split column: it differs between partitions by design.")
        _fail_unless(set(self.density_columns) == set(self.density_scales), "density_scales must give every density column a scale.")
        _fail_unless(self.identity_columns or not self.conflict_columns, "conflict_columns need identity_columns, which say what one observation is.")
        if self.molecular_similarity is not None:
            _share(self.molecular_similarity, "molecular_similarity")
            _fail_unless(self.smiles_column, "molecular_similarity needs a smiles_column.")


_AUDIT_CHECKS: dict[str, Callable[[object, str], None]] = {
    "group_columns provenance_columns feature_columns unavailable_features numeric_columns identity_columns conflict_columns identifier_columns density_columns": check_names,
    "split_column target_column smiles_column": _name,
    "check_missing": _flag,
    "min_bin_count min_neighbors max_pair_comparisons": _count,
    "conflict_tolerance density_radius": _not_negative,
    "correlation_threshold": _share,
    "bounds": _table(_limits),
    "units": _table(_unit),
    "sparse_bins": _table(_edges),
    "near_duplicates": _table(_tolerance),
    "density_scales": _table(_scale),
    "provenance_patterns": _table(_pattern),
    "unit_aliases": _table(_alias),
    "compositions": _compositions,
    "rules": _rules,
}


@dataclass
class SplitConfig:
    strategy: str
    columns: list[str]
    group_columns: list[str] = field(default_factory=list)
    test_size: float = 0.2
    seed: int = 0
    holdout_values: list | None = None
    cutoff: str | None = None
    threshold: float | None = None
    direction: str = "high"
    crossing_policy: str = "error"

    @property
    def bounded(self) -> bool:
        """Whether a boundary, and not a choice of groups, makes the split."""
        return self.strategy in ("time", "extrapolation")

    def __post_init__(self):
        _fail_unless(self.strategy in STRATEGIES, f"strategy is one of {', '.join(STRATEGIES)}.")
        check_names(self.columns, "columns")
        check_names(self.group_columns, "group_columns")
        _fail_unless(len(self.columns) == 1 or (self.strategy == "composition" and self.columns), f"A {self.strategy} split takes one column.")
        _fail_unless(is_number(self.test_size) and 0 < self.test_size < 1, "test_size must lie between 0 and 1.")
        _fail_unless(isinstance(self.seed, int) and not isinstance(self.seed, bool), "seed must be a whole number.")
        _fail_unless(self.direction in ("high", "low"), "direction is high or low.")
        _fail_unless(self.crossing_policy in ("error", "exclude"), "crossing_policy is error or exclude.")
        if self.strategy == "time":
            _fail_unless(isinstance(self.cutoff, str) and ISO_START.match(self.cutoff), "A time split needs a cutoff that is an absolute ISO date or timestamp.")
        if self.strategy == "extrapolation":
            _fail_unless(is_number(self.threshold), "An extrapolation split needs a finite threshold.")
        if self.holdout_values is not None:
            _check_holdouts(self.holdout_values)
        for wrong, message in self._misplaced():
            _fail_unless(not wrong, message)

    def _misplaced(self) -> Iterable[tuple[object, str]]:
        """Settings that could have no effect on this split."""
        yield self.strategy != "time" and self.cutoff is not None, "cutoff belongs to time splits."
        yield self.strategy != "extrapolation" and (self.threshold is not None or self.direction != "high"), "threshold and direction belong to extrapolation splits."
        yield self.strategy != "laboratory" and self.holdout_values is not None, "holdout_values belong to laboratory splits."
        yield not self.bounded and self.crossing_policy != "error", "crossing_policy belongs to splits at a boundary."
        explicit = self.bounded or self.holdout_values is not None
        yield explicit and (self.test_size, self.seed) != (0.2, 0), "test_size and seed have no effect on this split."


def _check_holdouts(values: object) -> None:
    _fail_unless(isinstance(values, list) and values, "holdout_values must be a nonempty list.")
    _fail_unless(all(isinstance(v, str) or is_number(v) for v in values), "holdout_values are strings or finite numbers.")
    _fail_unless(len(set(values)) == len(values), "holdout_values has a value twice.")
