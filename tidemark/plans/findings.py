"""Findings, and the plan that turns many checks into few jobs.

A check is planned as a row mask (a boolean column) or as a DataFrame of rows.
All masks, and all other numbers that checks ask for, are taken in one
aggregation over the table; only checks that found something run a query for
their evidence, and the full list of rows stays a DataFrame until it is asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import ROW, Table

EVIDENCE = 20  # rows shown for a finding
DETAILS = 10_000  # values a detail lists; a finding's values_df has all
FUSED = 150  # aggregates in one job


def json_safe(value: object) -> object:
    """Strict JSON: NaN and missing are null, infinities text, times ISO, anything else its text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return float(value) if isinstance(value, Decimal) else str(value)


class JsonResult:
    def to_dict(self) -> dict:
        raise NotImplementedError

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, allow_nan=False) + "\n"


class Finding:
    """One finding.  ``rows_df`` has the positions of all its rows, ``values_df`` what a check worked out for them, if anything.

    ``rows`` and ``details`` run queries when first read; ``rows`` brings all positions to the
    driver, so it is for results that fit there, as are JSON and other reports.  ``mask`` says which rows of the
    table are meant, ``among`` which of a table (value, row position) that several findings share.
    """

    def __init__(self, table: Table, code: str, severity: str, columns: list[str], message: str, suggestion: str, affected: int, rows_df: DataFrame | Callable[[], DataFrame], known: dict, late: Callable[[], dict] | None = None, mask: Column | None = None, among: tuple[DataFrame, int] | None = None, values_df: DataFrame | None = None):
        self.code, self.severity, self.columns, self.message, self.suggestion = code, severity, columns, message, suggestion
        self.affected_count, self._rows_df = affected, rows_df
        self.mask, self.among, self.values_df = mask, among, values_df
        self._table, self._known, self._late = table, known, late
        self._rows: list[int] | None = None
        self._details: dict | None = None

    def __repr__(self):
        return f"Finding({self.code}, {self.severity}, {self.columns}, {self.affected_count} rows)"

    @property
    def rows_df(self) -> DataFrame:
        if callable(self._rows_df):
            self._rows_df = self._rows_df()
        return self._rows_df

    @property
    def rows(self) -> list[int]:
        if self._rows is None:
            self._rows = sorted(r[0] for r in self.rows_df.collect()) if self.affected_count else []
        return self._rows

    @property
    def details(self) -> dict:
        if self._details is None:
            t, shown = self._table, []
            names = [c for c in dict.fromkeys(self.columns) if c in t]
            if self.affected_count:
                first = self.rows_df.orderBy(ROW).limit(EVIDENCE)
                shown = t.df.join(F.broadcast(first), ROW, "left_semi").select(ROW, *[t.inner(c) for c in names]).orderBy(ROW).collect()
            more = self._known | (self._late() if self._late else {})
            truncated = self.affected_count > EVIDENCE or more.pop("examples_truncated", False)
            self._details = more | {
                "affected_count": self.affected_count,
                "raw_examples": [dict(zip(names, r[1:], strict=True)) for r in shown],
                "row_examples": [r[0] for r in shown],
                "examples_truncated": truncated,
            }
        return self._details

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("code", "severity", "columns", "rows", "message", "suggestion", "details")}


class AuditReport(JsonResult):
    def __init__(self, table: Table, findings: list[Finding], checks_run: list[str], checks_skipped: dict[str, str], metadata: dict):
        self.table, self.findings, self.checks_run, self.checks_skipped, self.metadata = table, findings, checks_run, checks_skipped, metadata
        self.n_rows = table.n

    @property
    def findings_df(self) -> DataFrame:
        """A row a finding: seq, code, severity, columns, affected_count, message, suggestion."""
        shape = "seq int, code string, severity string, columns array<string>, affected_count long, message string, suggestion string"
        rows = [(i, f.code, f.severity, f.columns, f.affected_count, f.message, f.suggestion) for i, f in enumerate(self.findings)]
        return self.table.spark.createDataFrame(rows, shape)

    @property
    def finding_rows_df(self) -> DataFrame:
        """``(seq, row position)`` of all findings, never collected: one scan for all masks, one join for findings that share a table."""
        parts, masks, shared = [], [], {}
        for i, f in enumerate(self.findings):
            if f.mask is not None:
                masks.append(F.when(f.mask, F.lit(i)))
            elif f.among is not None:
                shared.setdefault(id(f.among[0]), (f.among[0], []))[1].append((f.among[1], i))
            else:
                parts.append(f.rows_df.select(F.lit(i).alias("seq"), ROW))
        for at in range(0, len(masks), FUSED):
            parts.append(self.table.df.select(F.explode(F.array_compact(F.array(*masks[at : at + FUSED]))).alias("seq"), ROW))
        for rows, numbers in shared.values():
            parts.append(rows.join(F.broadcast(self.table.spark.createDataFrame(numbers, "value long, seq int")), "value").select("seq", ROW))
        return reduce(DataFrame.unionByName, parts) if parts else self.table.spark.createDataFrame([], f"seq int, {ROW} long")

    def to_dict(self) -> dict:
        return json_safe({"n_rows": self.n_rows, "findings": [f.to_dict() for f in self.findings], "checks_run": self.checks_run, "checks_skipped": self.checks_skipped, "metadata": self.metadata})


class Planner:
    """Collects what checks want to know, runs it at once, then lets them report in order."""

    def __init__(self, table: Table):
        self.table = table
        self.wanted: list[Column] = []
        self.values: list = []
        self.reports: list[Callable[[], None]] = []
        self.findings: list[Finding] = []

    def want(self, number: Column) -> int:
        self.wanted.append(number)
        return len(self.wanted) - 1

    def got(self, handle: int):
        return self.values[handle]

    def add(self, code: str, severity: str, columns: list[str], rows: DataFrame | Callable[[], DataFrame], affected: int, message: str, suggestion: str, known: dict | None = None, late: Callable[[], dict] | None = None, **source) -> None:
        self.findings.append(Finding(self.table, code, severity, columns, message, suggestion, affected, rows, known or {}, late, **source))

    def mask(self, code: str, severity: str, columns: list[str], mask: Column, message: str, suggestion: str, known: Callable[[int], dict] | dict | None = None, late: Callable[[], dict] | None = None, unless: Callable[[int], bool] | None = None, values_df: DataFrame | None = None) -> None:
        """Plan a finding over the rows where ``mask`` is true; reported if there are any, or as ``unless`` says of their number."""
        mask = F.coalesce(mask, F.lit(False))
        handle = self.want(F.count_if(mask))

        def report():
            n = self.got(handle)
            if not n if unless is None else unless(n):
                return
            found = known(n) if callable(known) else dict(known or {})
            self.add(code, severity, columns, lambda: self.table.rows(mask), n, message, suggestion, found, late, mask=mask, values_df=values_df)

        self.reports.append(report)

    def then(self, report: Callable[[], None]) -> None:
        self.reports.append(report)

    def run(self) -> list[Finding]:
        for at in range(0, len(self.wanted), FUSED):
            part = self.wanted[at : at + FUSED]
            self.values += list(self.table.df.agg(*[c.alias(f"v{i}") for i, c in enumerate(part)]).first())
        for report in self.reports:
            report()
        return self.findings


def metadata(table: Table, config) -> dict:
    from importlib.metadata import PackageNotFoundError, version

    from tidemark import __version__
    from tidemark.sources.tables import FINGERPRINT_FORMAT

    found = {}
    for package in ("pyspark", "numpy", "pandas", "rdkit"):
        try:
            found[package] = version(package)
        except PackageNotFoundError:
            continue
    return {
        "tool_version": __version__,
        "row_reference": "zero-based position in the order in which the table was bound",
        "dataset_sha256": table.fingerprint(),
        "fingerprint_format": FINGERPRINT_FORMAT,
        "config": asdict(config),
        "dependencies": found,
    }
