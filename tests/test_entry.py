import os
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
#: One of each kind; the driver compares them all.
COMPARED = ["missing_values", "invalid_numeric", "sparse_bins", "weak_provenance", "duplicate_split_overlap", "group_split_overlap", "conflicting_samples", "unit_conversion", "rule_unknown", "near_duplicate_findings", "density", "split_time_exclude", "components_of_suppliers", "row_violations", "strict_csv", "fingerprint", "reports", "command_line", "configurations", "impossible_requests", "presets", "molecule_findings", "tanimoto", "split_scaffold", "conflict_findings", "evidence", "pair_examples", "near_duplicates", "split_diagnostics_time", "split_diagnostics_seeded", "components", "audit_report"]


def shown(frame):
    text = lambda v: "-" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


def test_every_oracle_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("absent", ["tidemark.llm", "tidemark.llm.queries", "xxhash"])
def test_own_queries_stay_without_the_pipeline_operators(monkeypatch, absent):
    for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    assert "missing_values" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", COMPARED)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and shown(got) == shown(expected)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
