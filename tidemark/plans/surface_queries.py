"""Queries of what surrounds the checks, each with SQL: sources, reports, the command line, configuration, molecules, diagnostics.

What says no (wrong settings, impossible splits) gives a row a case with its outcome; the
SQL states the outcomes.  Molecules are looked at through a stand-in backend whose
"molecules" are short strings of letters, so that all but the chemistry is tried.
"""

from __future__ import annotations

import json
import sys
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import molecules
from tidemark.operators.audit import audit
from tidemark.operators.pairs import band_pairs, points, tanimoto_pairs
from tidemark.operators.split import held_ranks, split
from tidemark.plans.config import AuditConfig, SplitConfig
from tidemark.plans.presets import available_plugins, preset
from tidemark.plans.queries import MANY, PART3, PRICE_SQL, PRICES, UNIT, UNIT_CONFIG, _findings, _query, _read, _rows, _rule, _split, _summary
from tidemark.sources.csv import CsvProblem, read_strict
from tidemark.sources.reports import render, write_new
from tidemark.sources.tables import ROW, bind


def _outcome(work: Callable[[], object]) -> str:
    try:
        work()
    except (ValueError, TypeError, OSError) as e:
        return "refused" if not isinstance(e, FileExistsError) else "there already"
    return "accepted"


def _values(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") t(name, outcome)"


# sources


@_query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS position, n_nationkey::VARCHAR AS "key", n_name || chr(10) || '"' || n_regionkey || '",' AS note, '' AS blank FROM nation""")
def strict_csv(spark, sf_dir):
    """A file of quoted cells with line ends, quotes and commas, blank cells and blank lines, read back."""
    rows = sorted(_read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").collect())  # 25 rows at any size
    lines = [f'{r[0]},"{r[1]}\n""{r[2]}"",",' for r in rows]
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "nation.csv")
        path.write_bytes(b"\xef\xbb\xbfkey,note,blank\r\n" + "\r\n\r\n".join(lines).encode())
        table, _ = read_strict(spark, path)
    return table.withColumnRenamed(ROW, "position")


CSV_CASES = {
    "plain": (b"a,b\n1,2\n", "accepted"), "mark and no end": (b"\xef\xbb\xbfa,b\n1,2", "accepted"), "header alone": (b"a,b\n", "accepted"), "long record": (b"a,b\n1,2,3\n", "refused"), "short record": (b"a,b\n1\n", "refused"),
    "open quote": (b'a,b\n1,"2\n', "refused"), "text after a quote": (b'a,b\n"1"x,2\n', "refused"), "name twice": (b"a,a\n1,2\n", "refused"), "blank name": (b"a, \n1,2\n", "refused"), "empty": (b"", "refused"), "not UTF-8": (b"a\n\xe9\n", "refused"),
}


@_query(_values({k: v for k, (_, v) in CSV_CASES.items()}))
def strict_csv_cases(spark, sf_dir):
    found = []
    with tempfile.TemporaryDirectory() as folder:
        for i, (name, (raw, _)) in enumerate(CSV_CASES.items()):
            path = Path(folder, f"{i}.csv")
            path.write_bytes(raw)
            try:
                read_strict(spark, path)
                found.append((name, "accepted"))
            except CsvProblem:
                found.append((name, "refused"))
    return _summary(spark, found, "name string, outcome string")


@_query("""
WITH j AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, '{"__row_id":' || (row_number() OVER (ORDER BY n_nationkey) - 1) || ',"c0":' || n_nationkey || ',"c1":"' || n_name || '","c2":' || n_regionkey || '}' AS t FROM nation),
h AS (SELECT sha256(t) AS h FROM j),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b, sum(('0x' || substr(h, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS d FROM h)
SELECT sha256('([''n_nationkey'', ''n_name'', ''n_regionkey''], [''' || n || ''', ''' || a::HUGEINT || ''', ''' || b::HUGEINT || ''', ''' || c::HUGEINT || ''', ''' || d::HUGEINT || '''])') AS dataset_sha256, n::BIGINT AS n FROM s""")
def fingerprint(spark, sf_dir):
    table = bind(_read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), order_by="n_nationkey")
    return _summary(spark, [(table.fingerprint(), table.n)], "dataset_sha256 string, n long")


# reports and the command line


@_query("""
WITH n AS (SELECT count(*) AS rows_, count(*) FILTER (s_acctbal < 0) AS below FROM supplier)
SELECT format, begins, rows_ AS n_rows, below, 'there already' AS again FROM n, (VALUES ('json', '{'), ('markdown', '# '), ('html', '<!DOCTYPE html>')) f(format, begins)""")
def reports(spark, sf_dir):
    """One report in each format, written once: how it begins, and what is read from it again."""
    report = audit(_read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"), AuditConfig(bounds={"s_acctbal": [0, None]}))
    data = json.loads(report.to_json())
    below = sum(f["details"]["affected_count"] for f in data["findings"] if f["code"] == "out_of_bounds")
    found = []
    with tempfile.TemporaryDirectory() as folder:
        for kind, begins in (("json", "{"), ("markdown", "# "), ("html", "<!DOCTYPE html>")):
            text, path = render(report, kind), Path(folder, "made", kind)
            write_new(path, text)
            same = path.read_text(encoding="utf-8") == text and text.startswith(begins) and ("out_of_bounds" in text) == bool(below)
            found.append((kind, begins if same else text[:9], data["n_rows"], below, _outcome(lambda path=path: write_new(path, "other"))))
    return _summary(spark, found, "format string, begins string, n_rows long, below long, again string")


@_query("""
SELECT * FROM (VALUES ('audit, never', 0), ('audit, error', 1), ('audit, warning', 1), ('audit again', 2), ('audit, wrong name', 2), ('split', 0), ('split, absent column', 2), ('preset', 0), ('preset again', 2), ('plugins', 0)) t(command, code)""")
def command_line(spark, sf_dir):
    """Exit codes of commands over a file with a value below its bound."""
    with tempfile.TemporaryDirectory() as folder, _quiet():
        at = lambda name: str(Path(folder, name))
        Path(at("t.csv")).write_text("x,y\n-1,a\n2,b\n3,b\n")
        for name, config in {"bounds": {"bounds": {"x": [0, None]}}, "wrong": {"bound": {}}, "split": {"strategy": "extrapolation", "columns": ["x"], "threshold": 1}, "absent": {"strategy": "composition", "columns": ["z"]}, "roles": {"density": "x"}}.items():
            Path(at(name)).write_text(json.dumps(config))
        on = lambda command, config, output, *more: [command, at("t.csv"), "--config", at(config), "--output", at(output), *more]
        made = ["preset", "materials", "--columns", at("roles"), "--output", at("p")]
        commands = {
            "audit, never": on("audit", "bounds", "a"), "audit, error": on("audit", "bounds", "b", "--fail-on", "error"), "audit, warning": on("audit", "bounds", "c", "--format", "html", "--fail-on", "warning"), "audit again": on("audit", "bounds", "a"), "audit, wrong name": on("audit", "wrong", "d"),
            "split": on("split", "split", "e"), "split, absent column": on("split", "absent", "f"), "preset": made, "preset again": made, "plugins": ["plugins"],
        }
        found = [(name, cli.main(arguments)) for name, arguments in commands.items()]
    return _summary(spark, found, "command string, code int")


@contextmanager
def _quiet():
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        yield


# configuration

AUDIT_CASES = {
    "nothing": ("{}", "accepted"), "bounds": ('{"bounds": {"x": [0, 1]}}', "accepted"), "open bounds": ('{"bounds": {"x": [null, 1]}}', "accepted"), "bounds the wrong way round": ('{"bounds": {"x": [1, 0]}}', "refused"), "a field that is not": ('{"bound": {}}', "refused"),
    "bins that fall": ('{"sparse_bins": {"x": [0, 2, 1]}}', "refused"), "a count of none": ('{"min_bin_count": 0}', "refused"), "a name twice": ('{"group_columns": ["a", "a"]}', "refused"), "a pattern that is none": ('{"provenance_patterns": {"doi": "("}}', "refused"),
    "a rule": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "ge", "value": 1}}]}', "accepted"), "a rule of columns": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "lt", "other_column": "y"}}]}', "accepted"), "nested rules": ('{"rules": [{"name": "r", "assert": {"any": [{"column": "x", "op": "ge", "value": 1}, {"all": [{"column": "y", "op": "eq", "value": 2}]}]}}]}', "accepted"),
    "an operator that is none": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "like", "value": 1}}]}', "refused"), "no value": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "ge"}}]}', "refused"), "text for a number": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "ge", "value": "a"}}]}', "refused"), "all of nothing": ('{"rules": [{"name": "r", "assert": {"all": []}}]}', "refused"),
    "a rule without a name": ('{"rules": [{"assert": {"column": "x", "op": "ge", "value": 1}}]}', "refused"), "a severity that is none": ('{"rules": [{"name": "r", "severity": "fatal", "assert": {"column": "x", "op": "ge", "value": 1}}]}', "refused"), "a time that is never known": ('{"rules": [{"name": "r", "assert": {"column": "x", "op": "before", "value": "today"}}]}', "accepted"),
    "density without scales": ('{"density_columns": ["x"]}', "refused"), "a similarity above 1": ('{"smiles_column": "s", "molecular_similarity": 1.5}', "refused"), "a tolerance below 0": ('{"near_duplicates": {"x": -1}}', "refused"),
}
SPLIT_CASES = {
    "composition": ('{"strategy": "composition", "columns": ["a"]}', "accepted"), "seed and size": ('{"strategy": "composition", "columns": ["a"], "seed": 3, "test_size": 0.5}', "accepted"), "time": ('{"strategy": "time", "columns": ["t"], "cutoff": "2024-01-15"}', "accepted"), "names": ('{"strategy": "laboratory", "columns": ["a"], "holdout_values": ["x"]}', "accepted"),
    "no strategy": ('{"columns": ["a"]}', "refused"), "a strategy that is none": ('{"strategy": "random", "columns": ["a"]}', "refused"), "all of it": ('{"strategy": "composition", "columns": ["a"], "test_size": 1}', "refused"), "time without cutoff": ('{"strategy": "time", "columns": ["t"]}', "refused"), "a relative cutoff": ('{"strategy": "time", "columns": ["t"], "cutoff": "now"}', "refused"),
    "time with a seed": ('{"strategy": "time", "columns": ["t"], "cutoff": "2024-01-15", "seed": 1}', "refused"), "extrapolation without threshold": ('{"strategy": "extrapolation", "columns": ["x"]}', "refused"), "two columns of names": ('{"strategy": "laboratory", "columns": ["a", "b"], "holdout_values": ["x"]}', "refused"), "no column": ('{"strategy": "composition", "columns": []}', "refused"), "a misspelt field": ('{"strategy": "composition", "columns": ["a"], "testsize": 0.2}', "refused"),
}


@_query(_values({f"audit: {k}": v for k, (_, v) in AUDIT_CASES.items()} | {f"split: {k}": v for k, (_, v) in SPLIT_CASES.items()}))
def configurations(spark, sf_dir):
    """JSON settings, right and wrong, settled before any job runs."""
    tried = [(f"audit: {k}", AuditConfig, text) for k, (text, _) in AUDIT_CASES.items()] + [(f"split: {k}", SplitConfig, text) for k, (text, _) in SPLIT_CASES.items()]
    return _summary(spark, [(name, _outcome(lambda kind=kind, text=text: kind(**json.loads(text)).__post_init__())) for name, kind, text in tried], "name string, outcome string")


REFUSED_CASES = {
    "a column that is not there": "refused", "a rule on a column that is not there": "refused", "a split by a column that is not there": "refused", "an expected unit that is none": "refused", "pairs within the budget": "accepted", "pairs beyond the budget": "refused", "booleans as numbers": "refused",
    "molecules without their package": "refused", "scaffolds without their package": "refused", "nothing beyond the threshold": "refused", "one group only": "refused", "a name that no row has": "refused",
}


@_query(_values(REFUSED_CASES))
def impossible_requests(spark, sf_dir):
    """What can't be done with a table is refused whole, before a result is given."""
    df = _read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal AS v", "s_name AS s", "s_suppkey > 3 AS flag", "1 AS one")
    checks = {
        "a column that is not there": {"bounds": {"w": [0, 1]}}, "a rule on a column that is not there": {"rules": [{"name": "r", "assert": {"column": "w", "op": "ge", "value": 1}}]}, "an expected unit that is none": {"units": {"v": {"column": "s", "expected": "nonsense"}}},
        "pairs within the budget": {"near_duplicates": {"v": 0}, "max_pair_comparisons": MANY}, "pairs beyond the budget": {"near_duplicates": {"v": 0}, "max_pair_comparisons": 9}, "booleans as numbers": {"bounds": {"flag": [0, 1]}}, "molecules without their package": {"smiles_column": "s"},
    }
    splits = {
        "a split by a column that is not there": ("composition", ["w"], {}), "scaffolds without their package": ("scaffold", ["s"], {}), "nothing beyond the threshold": ("extrapolation", ["v"], {"threshold": 10**12}), "one group only": ("composition", ["one"], {}), "a name that no row has": ("laboratory", ["s"], {"holdout_values": ["nobody"]}),
    }
    with _without("rdkit"):
        found = [(name, _outcome(lambda config=config: audit(df, AuditConfig(**config)))) for name, config in checks.items()]
        found += [(name, _outcome(lambda a=strategy, b=columns, c=more: split(df, SplitConfig(a, b, **c)))) for name, (strategy, columns, more) in splits.items()]
    return _summary(spark, found, "name string, outcome string")


@contextmanager
def _without(package: str):
    """As if an optional package weren't installed."""
    had = sys.modules.get(package)
    sys.modules[package] = None  # type: ignore[assignment]
    try:
        yield
    finally:
        if had is None:
            del sys.modules[package]
        else:
            sys.modules[package] = had


PRESET_ROLES = {
    "batteries": {"cycle": "n", "temperature_k": "t", "source": "s"},
    "molecular": {"molecular_weight": "w", "smiles": "f", "sample_id": "i"},
    "materials": {"porosity_fraction": "p", "density": "d", "laboratory": "l", "measured_at": "m"},
    "process": {"pressure_absolute": "p", "mass_flow_magnitude": "q", "temperature_k": "t"},
}


@_query("""
SELECT * FROM (VALUES
  ('batteries', 'bounds', '{"cycle": [0, null], "t": [0, null]}'), ('batteries', 'provenance_columns', '["s"]'),
  ('molecular', 'bounds', '{"w": [0, null]}'), ('molecular', 'group_columns', '["i"]'), ('molecular', 'identifier_columns', '["i"]'), ('molecular', 'smiles_column', '"f"'),
  ('materials', 'bounds', '{"d": [0, null], "p": [0, 1]}'), ('materials', 'provenance_columns', '["l", "m"]'),
  ('process', 'bounds', '{"p": [0, null], "q": [0, null], "t": [0, null]}'),
  ('builtin', 'names', '["batteries", "materials", "molecular", "process"]')) t(preset, field, value)""".replace('"cycle"', '"n"'))
def presets(spark, sf_dir):
    """What each preset makes of its roles, and the names that are there without loading foreign code."""
    bare, found = asdict(AuditConfig()), []
    for name, roles in PRESET_ROLES.items():
        found += [(name, k, json.dumps(v, sort_keys=True)) for k, v in asdict(preset(name, roles)).items() if v != bare[k]]
    found.append(("builtin", "names", json.dumps(available_plugins()["builtin"])))
    return _summary(spark, found, "preset string, field string, value string")


# molecules, by a stand-in


class Letters:
    """A "molecule" is a string of letters: its identity is the letters in order, its bits say which occur, its scaffold is the first."""

    def describe(self, smiles: str):
        if "." in smiles:
            return None
        return "".join(sorted(smiles)), [sum(1 << (ord(c) - 97) for c in set(smiles))] + [0] * 31

    def scaffold(self, smiles: str) -> str:
        if "." in smiles:
            raise ValueError("Disconnected")
        return smiles[0]


@contextmanager
def _letters():
    own, molecules.backend_factory = molecules.backend_factory, Letters
    try:
        yield
    finally:
        molecules.backend_factory = own


_WORD = "substr('abcdefg', cast(1 + p_partkey % 7 AS int), 1) || substr('abcde', cast(1 + p_partkey % 5 AS int), 1) || substr('abc', cast(1 + p_partkey % 3 AS int), 1)"
_SMILES = f"CASE p_partkey % 29 WHEN 0 THEN NULL WHEN 1 THEN 'a.b' ELSE {_WORD} END"
_SET = "list_sort(list_distinct(string_split(s, '')))"


@_query(f"SELECT DISTINCT s AS smiles, CASE WHEN s <> 'a.b' THEN list_aggregate(list_sort(string_split(s, '')), 'string_agg', '') END AS identity, CASE WHEN s <> 'a.b' THEN len({_SET}) ELSE -1 END::INT AS bits FROM (SELECT {_SMILES} AS s FROM part) WHERE s IS NOT NULL")
def molecule_descriptions(spark, sf_dir):
    with _letters():
        found = molecules.describe(_read(spark, sf_dir, "part", f"{_SMILES} AS s"))
    return found.select("smiles", "identity", F.coalesce(F.aggregate("fp", F.lit(0), lambda a, x: a + F.bit_count(x)), F.lit(-1)).alias("bits"))


@_query(f"SELECT DISTINCT s AS smiles, CASE WHEN s <> 'a.b' THEN s[1] END AS scaffold, s = 'a.b' AS refused FROM (SELECT {_SMILES} AS s FROM part) WHERE s IS NOT NULL")
def scaffold_keys(spark, sf_dir):
    with _letters():
        found = molecules.scaffolds(_read(spark, sf_dir, "part", f"{_SMILES} AS s").where("s IS NOT NULL"))
    return found.select("smiles", "scaffold", F.col("problem").isNotNull().alias("refused"))


_TANIMOTO = "len(list_intersect(a.f, b.f)) / len(list_distinct(list_concat(a.f, b.f)))"
_MOLECULES = f"m AS (SELECT p_partkey, s, part, {_SET} AS f, list_aggregate(list_sort(string_split(s, '')), 'string_agg', '') AS identity FROM (SELECT p_partkey, {_SMILES} AS s, {PART3.format('p_partkey')} AS part FROM part) WHERE s <> 'a.b')"


@_query(f"""
WITH {_MOLECULES}, q AS (SELECT a.p_partkey AS i, b.p_partkey AS j, a.part AS x, b.part AS y FROM m a JOIN m b ON a.p_partkey < b.p_partkey AND {_TANIMOTO} >= 0.6), c AS (SELECT * FROM q WHERE x <> '' AND y <> '' AND x <> y)
SELECT code, n, pairs FROM (
  SELECT 'invalid_molecule' AS code, (SELECT count(*) FROM part WHERE p_partkey % 29 IN (0, 1)) AS n, -1::BIGINT AS pairs
  UNION ALL SELECT 'duplicate_molecules', (SELECT sum(k)::BIGINT FROM (SELECT count(*) AS k FROM m GROUP BY identity) WHERE k > 1), -1
  UNION ALL SELECT 'near_duplicate_samples', (SELECT count(*) FROM (SELECT i FROM q UNION SELECT j FROM q)), (SELECT count(*) FROM q)
  UNION ALL SELECT 'near_duplicate_split_overlap', (SELECT count(*) FROM (SELECT i FROM c UNION SELECT j FROM c)), (SELECT count(*) FROM c)) WHERE n > 0""")
def molecule_findings(spark, sf_dir):
    df = _read(spark, sf_dir, "part", "p_partkey", f"{_SMILES} AS s", f"{PART3.format('p_partkey')} AS part")
    with _letters():
        found, _ = _findings(df, AuditConfig(smiles_column="s", molecular_similarity=0.6, split_column="part", max_pair_comparisons=MANY), "_molecules")
    return _summary(spark, [(f.code, f.affected_count, f._known.get("pair_count", -1)) for f in found], "code string, n long, pairs long")


@_query(f"WITH {_MOLECULES}, p AS (SELECT f, min(p_partkey) AS point FROM m GROUP BY f) SELECT a.point AS a, b.point AS b, round({_TANIMOTO}, 9) AS score FROM p a JOIN p b ON a.point < b.point AND {_TANIMOTO} >= 0.5")
def tanimoto(spark, sf_dir):
    """Pairs of different fingerprints at least half alike, each named by its first row."""
    df = _read(spark, sf_dir, "part", "p_partkey", f"{_SMILES} AS smiles")
    with _letters():
        known = molecules.describe(df.select("smiles"))
    pts = df.join(known.where("fp IS NOT NULL"), "smiles").groupBy("fp").agg(F.min("p_partkey").alias("point"))
    return tanimoto_pairs(pts, 0.5).select("a", "b", F.round("score", 9).alias("score"))


_SEVEN = ", ".join(map(str, held_ranks(7, 0.3, 7)))


@_query(f"""
WITH p AS (SELECT p_partkey, ({_WORD})[1] AS k FROM part), g AS (SELECT k, rank() OVER (ORDER BY min(p_partkey)) - 1 AS r FROM p GROUP BY 1)
SELECT p_partkey, CASE WHEN r IN ({_SEVEN}) THEN 'test' ELSE 'train' END AS label FROM p JOIN g USING (k)""")
def split_scaffold(spark, sf_dir):
    df = _read(spark, sf_dir, "part", "p_partkey", f"{_WORD} AS s")
    with _letters():
        return _split(df, "p_partkey", SplitConfig("scaffold", ["s"], test_size=0.3, seed=7))


# rules, patterns and findings by their whole paths


@_query("""
SELECT 'after' AS op, event_id FROM events WHERE NOT ts > TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'on_or_after', event_id FROM events WHERE NOT ts >= TIMESTAMP '2024-01-15 12:00:00'
UNION ALL SELECT 'on_or_before', event_id FROM events WHERE NOT ts <= TIMESTAMP '2024-01-15 12:00:00'""")
def rule_temporal_others(spark, sf_dir):
    out = None
    for op in ("after", "on_or_after", "on_or_before"):
        own = _rule(spark, sf_dir, "events", ("event_id", "ts"), {"assert": {"column": "ts", "op": op, "value": "2024-01-15T07:00:00-05:00"}}, "event_id").select(F.lit(op).alias("op"), "event_id")
        out = own if out is None else out.unionByName(own)
    return out


@_query("SELECT c_custkey FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#0+[0-9]*[13579]')")
def weak_provenance_python(spark, sf_dir):
    """A pattern that Java reads otherwise (a named group, \\Z) goes through Arrow batches."""
    return _rows(_read(spark, sf_dir, "customer", "c_custkey", "c_name"), AuditConfig(provenance_patterns={"c_name": r"(?P<kind>Customer)#0+[0-9]*[13579]\Z"}), "_weak", "weak_provenance", "c_custkey")


@_query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0.07 AND l_quantity > 45 THEN 'high' ELSE 'low' END AS tax FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, max(l_quantity) - min(l_quantity) > 44 AS q, min(tax) <> max(tax) AS t FROM l GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, l_quantity, array_to_string(['l_orderkey', 'l_linenumber'] || CASE WHEN q THEN ['l_quantity'] ELSE [] END || CASE WHEN t THEN ['tax'] ELSE [] END, ',') AS columns
FROM l JOIN g USING (l_orderkey, l_linenumber) WHERE (q OR t)""")
def conflict_findings(spark, sf_dir):
    """Rows and columns of every finding of conflicting observations, by the report's own path."""
    df = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "CASE WHEN l_tax > 0.07 AND l_quantity > 45 THEN 'high' ELSE 'low' END AS tax")
    found, a = _findings(df, AuditConfig(identity_columns=["l_orderkey", "l_linenumber"], conflict_columns=["l_quantity", "tax"], conflict_tolerance=44), "_conflicts")
    from tidemark.plans.findings import AuditReport

    rows = AuditReport(a.t, found, [], {}, {}).finding_rows_df
    named = spark.createDataFrame([(i, ",".join(f.columns)) for i, f in enumerate(found)], "seq int, columns string")
    keys = a.t.df.select(ROW, *[a.t.col(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")])
    return rows.join(F.broadcast(named), "seq").join(keys, ROW).select("l_orderkey", "l_linenumber", "l_quantity", "columns")


@_query("""
WITH p AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer),
b AS (SELECT *, row_number() OVER (ORDER BY place) AS k, count(*) OVER () AS n FROM p WHERE c_acctbal < 0)
SELECT place AS position, c_custkey, n AS affected, n > 20 AS truncated FROM b WHERE k <= 20""")
def evidence(spark, sf_dir):
    """The rows shown for a finding: the first twenty by position, though all are counted."""
    table = bind(_read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), order_by="c_custkey")
    report = audit(table.df.select(ROW, *[table.col(c).alias(c) for c in table.names]), AuditConfig(bounds={"c_acctbal": [0, None]}))
    found = next(f for f in report.findings if f.code == "out_of_bounds")
    keys = {r[0]: r[1] for r in table.df.where(F.col(ROW).isin(found.details["row_examples"])).select(ROW, table.col("c_custkey")).collect()}
    return _summary(spark, [(at, keys[at], found.affected_count, found.details["examples_truncated"]) for at in found.details["row_examples"]], "position long, c_custkey long, affected long, truncated boolean")


@_query(f"""
WITH {PRICE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM (SELECT p_partkey, p_retailprice AS price, p_size FROM part)),
q AS (SELECT a.place AS i, b.place AS j FROM n a JOIN n b ON a.place < b.place AND abs(a.price - b.price) <= 0.5 AND abs(a.p_size - b.p_size) <= 1 WHERE a.p_partkey % 37 <> 0 AND b.p_partkey % 37 <> 0)
SELECT i, j FROM q ORDER BY i, j LIMIT 100""")
def pair_examples(spark, sf_dir):
    """The pairs shown for near duplicates: the first hundred, in order of rows."""
    table = bind(_read(spark, sf_dir, "part", *PRICES), order_by="p_partkey")
    own = table.df.select(ROW, *[table.col(c).alias(c) for c in table.names])
    found = next(f for f in audit(own, AuditConfig(near_duplicates={"price": 0.5, "p_size": 1}, max_pair_comparisons=MANY)).findings if f.code == "near_duplicate_samples")
    return _summary(spark, [tuple(p[:2]) for p in found.details["pair_examples"]], "i long, j long")


@_query(f"""
WITH {PRICE_SQL}, r AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY price, p_size) AS point, price, p_size FROM p), o AS (SELECT * FROM r WHERE p_partkey = point)
SELECT 'pair' AS kind, a.point AS i, b.point AS j FROM o a JOIN o b ON a.point < b.point AND abs(a.price - b.price) <= 0.5 AND a.p_size = b.p_size
UNION ALL SELECT 'member', point, p_partkey FROM r""")
def near_duplicates(spark, sf_dir):
    """Pairs of different points, each named by its first row, and which rows lie at each: rows that are alike aren't paired off."""
    own = _read(spark, sf_dir, "part", *PRICES).where("price < double('Infinity')").selectExpr(f"p_partkey AS {ROW}", "price AS x0", "double(p_size) AS x1")
    pts = points(own, ["x0", "x1"])
    named = own.join(pts.select("point", "x0", "x1"), ["x0", "x1"]).select(F.col(ROW).alias("row"), "point")
    first = named.groupBy("point").agg(F.min("row").alias("first"))
    links = band_pairs(pts, {"x0": 0.5, "x1": 0.0})
    ends = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    pairs = ends.select(F.lit("pair").alias("kind"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return pairs.unionByName(named.join(first, "point").select(F.lit("member").alias("kind"), F.col("first").alias("i"), F.col("row").alias("j")))


# splits: diagnostics


@_query("""
WITH e AS (SELECT event_id, ts, event_id // 3 AS g, ts > TIMESTAMP '2024-01-15' AS late FROM events),
s AS (SELECT *, count(DISTINCT late) OVER (PARTITION BY g) > 1 AS torn FROM e),
n AS (SELECT count(*) FILTER (NOT torn AND NOT late) AS train, count(*) FILTER (NOT torn AND late) AS test, count(*) FILTER (torn) AS excluded, count(DISTINCT g) FILTER (torn) AS torn,
  min(ts) FILTER (NOT torn AND NOT late) AS a, max(ts) FILTER (NOT torn AND NOT late) AS b, min(ts) FILTER (NOT torn AND late) AS c, max(ts) FILTER (NOT torn AND late) AS d FROM s)
SELECT name, value FROM (
  SELECT 'n_train' AS name, train::VARCHAR AS value FROM n UNION ALL SELECT 'n_test', test::VARCHAR FROM n UNION ALL SELECT 'n_excluded', excluded::VARCHAR FROM n
  UNION ALL SELECT 'actual_test_row_fraction', round(test / (train + test), 6)::VARCHAR FROM n UNION ALL SELECT 'excluded_crossing_groups', torn::VARCHAR FROM n
  UNION ALL SELECT 'group_overlap_counts.g', '0' UNION ALL SELECT 'boundary.cutoff_utc', '2024-01-15T00:00:00+00:00' UNION ALL SELECT 'boundary.train', '<= cutoff' UNION ALL SELECT 'boundary.test', '> cutoff'
  UNION ALL SELECT 'train.low', strftime(a, '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM n UNION ALL SELECT 'train.high', strftime(b, '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM n
  UNION ALL SELECT 'test.low', strftime(c, '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM n UNION ALL SELECT 'test.high', strftime(d, '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM n)""")
def split_diagnostics_time(spark, sf_dir):
    d = split(_read(spark, sf_dir, "events", "event_id", "ts", "event_id div 3 AS g"), SplitConfig("time", ["ts"], ["g"], cutoff="2024-01-15", crossing_policy="exclude")).diagnostics
    rows = [(k, str(d[k])) for k in ("n_train", "n_test", "n_excluded", "excluded_crossing_groups")] + [("actual_test_row_fraction", str(round(d["actual_test_row_fraction"], 6)))]
    rows += [(f"group_overlap_counts.{k}", str(v)) for k, v in d["group_overlap_counts"].items()] + [(f"boundary.{k}", v) for k, v in d["boundary"].items()]
    rows += [(f"{x}.{end}", t) for x in ("train", "test") for end, t in zip(("low", "high"), d["observed_ranges"][x], strict=True)]
    return _summary(spark, rows, "name string, value string")


@_query(f"""
WITH g AS (SELECT c_nationkey AS k, rank() OVER (ORDER BY min(c_custkey)) - 1 AS r FROM customer GROUP BY 1), s AS (SELECT *, r IN ({", ".join(map(str, held_ranks(25, 0.3, 7)))}) AS held FROM customer JOIN g ON k = c_nationkey)
SELECT count(*) FILTER (NOT held) AS n_train, count(*) FILTER (held) AS n_test, 0::BIGINT AS n_excluded, round(count(*) FILTER (held) / count(*), 6) AS fraction, count(DISTINCT k) FILTER (held) AS heldout_components, count(DISTINCT k) AS independent_components,
  count(DISTINCT k) AS scientific_groups, 0::BIGINT AS scientific_group_overlap, 0::BIGINT AS overlap, 0.3::DOUBLE AS requested, 'seeded holdout of connected groups' AS selection, count(*) AS labelled_rows FROM s""")
def split_diagnostics_seeded(spark, sf_dir):
    """Everything a seeded split says of itself, and that each row has one label."""
    df = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_nationkey * 2 AS twin")
    result = split(df, SplitConfig("laboratory", ["c_nationkey"], ["twin"], test_size=0.3, seed=7), order_by="c_custkey")
    d = result.diagnostics
    rows, distinct = result.assignments_df.agg(F.count("*"), F.count_distinct(ROW)).first()
    made = (d["n_train"], d["n_test"], d["n_excluded"], round(d["actual_test_row_fraction"], 6), d["heldout_components"], d["independent_components"], d["scientific_groups"], d["scientific_group_overlap"], d["group_overlap_counts"]["twin"], d["requested_test_group_fraction"], d["selection"], rows if rows == distinct else -1)
    return _summary(spark, [made], "n_train long, n_test long, n_excluded long, fraction double, heldout_components long, independent_components long, scientific_groups long, scientific_group_overlap long, overlap long, requested double, selection string, labelled_rows long")


@_query("""
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey % 400 AS a, 1000000 + o_orderkey // 50 AS b FROM orders),
e AS (SELECT DISTINCT a AS u, b AS v FROM o), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(n, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY 1)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY c) AS component FROM o JOIN m ON m.n = o.a""")
def components(spark, sf_dir):
    from tidemark.operators.split import row_components

    rows = _read(spark, sf_dir, "orders").selectExpr(f"o_orderkey AS {ROW}", "o_custkey % 400 AS a", "o_orderkey div 50 AS b")
    return row_components(rows, [["a"], ["b"]]).select(F.col(ROW).alias("o_orderkey"), "component")


@_query(f"""
WITH s AS (SELECT s_suppkey, s_nationkey AS k, {PART3.format('s_suppkey')} AS part, {UNIT} AS u, CASE {UNIT} WHEN 'K' THEN s_acctbal WHEN 'degC' THEN s_acctbal + 273.15 WHEN 'mK' THEN s_acctbal / 1000 END AS kelvin FROM supplier),
g AS (SELECT k, count(*) AS n, count(DISTINCT nullif(part, '')) > 1 AS torn FROM s GROUP BY 1), j AS (SELECT * FROM s JOIN g USING (k)),
f(place, code, severity, columns, affected_count) AS (
  SELECT 0, 'missing_unit', 'error', 'v,u', count(*) FILTER (u IS NULL) FROM j UNION ALL SELECT 1, 'unit_mismatch', 'warning', 'v,u', count(*) FILTER (u <> 'K') FROM j
  UNION ALL SELECT 2, 'unit_conversion', 'info', 'v,u', count(*) FILTER (u = 'degC') FROM j UNION ALL SELECT 3, 'incompatible_units', 'error', 'v,u', count(*) FILTER (u = 'm') FROM j
  UNION ALL SELECT 4, 'unknown_unit', 'error', 'v,u', count(*) FILTER (u = 'mystery') FROM j UNION ALL SELECT 5, 'unit_conversion', 'info', 'v,u', count(*) FILTER (u = 'mK') FROM j
  UNION ALL SELECT 6, 'duplicate_samples', 'warning', 's_nationkey', count(*) FILTER (n > 1) FROM j UNION ALL SELECT 7, 'missing_split', 'error', 'part', count(*) FILTER (part = '') FROM j
  UNION ALL SELECT 8, 'duplicate_split_overlap', 'error', 's_nationkey,part', count(*) FILTER (torn AND part <> '') FROM j UNION ALL SELECT 9, 'group_split_overlap', 'error', 's_nationkey,part', count(*) FILTER (torn AND part <> '') FROM j
  UNION ALL SELECT 10, 'invalid_numeric', 'error', 'v', count(*) FILTER (kelvin IS NULL) FROM j UNION ALL SELECT 11, 'out_of_bounds', 'error', 'v', count(*) FILTER (kelvin < 0) FROM j
  UNION ALL SELECT 12, 'missing_values', 'warning', 'u', count(*) FILTER (u IS NULL) FROM j UNION ALL SELECT 13, 'missing_values', 'warning', 'part', count(*) FILTER (part = '') FROM j)
SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS seq, code, severity, columns, affected_count FROM f WHERE affected_count > 0""")
def audit_report(spark, sf_dir):
    """The full report over a table with several kinds of defect, in its order."""
    df = _read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal AS v", f"{UNIT} AS u", "s_nationkey", f"{PART3.format('s_suppkey')} AS part")
    config = AuditConfig(**UNIT_CONFIG, bounds={"v": [0, None]}, split_column="part", group_columns=["s_nationkey"], duplicate_columns=["s_nationkey"])
    return audit(df, config, order_by="s_suppkey").findings_df.select("seq", "code", "severity", F.array_join("columns", ",").alias("columns"), "affected_count")

