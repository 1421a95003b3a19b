"""One query an operator, over the driver's tables, and SQL that says what it must return.

The tables hold no defects, so each query first derives columns that do, by
expressions over the keys; the SQL repeats them.  Whole tables are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.audit import Audit
from tidemark.operators.pairs import neighbour_counts
from tidemark.operators.split import held_ranks, row_components, split
from tidemark.plans.config import AuditConfig, SplitConfig
from tidemark.plans.findings import Finding
from tidemark.plans.presets import preset
from tidemark.sources.tables import ROW, bind
from tidemark.streaming.rows import violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.selectExpr(*columns) if columns else df


def _findings(df: DataFrame, config: AuditConfig, *parts: str) -> tuple[list[Finding], Audit]:
    """The findings of some parts of the audit alone."""
    a = Audit(bind(df), config)
    a.known = {n: a.p.want(F.count_if(~a.t.missing(n))) for n in a.t.names} if "_identifiers" in parts else {}
    for part in parts:
        getattr(a, part)()
    return a.p.run(), a


def _rows(df: DataFrame, config: AuditConfig, part: str, code: str, key: str | list[str]) -> DataFrame:
    """Keys of the rows of all findings with a code."""
    found, a = _findings(df, config, *part.split())
    keys = [key] if isinstance(key, str) else key
    out = a.t.df.where("false").select(ROW)
    for f in found:
        if f.code == code:
            out = out.unionByName(f.rows_df)
    return a.t.df.join(out, ROW, "left_semi").select(*[a.t.col(k).alias(k) for k in keys])


def _summary(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame(rows, shape)


# single rows

SEGMENT = "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN ' \t ' ELSE c_mktsegment END"


@_query("""
SELECT column_name, affected, round(affected / n, 9) AS fraction FROM (
  SELECT 'seg' AS column_name, count(*) FILTER (c_custkey % 17 = 0 OR c_custkey % 19 = 0) AS affected, count(*) AS n FROM customer
  UNION ALL SELECT 'bal', count(*) FILTER (c_custkey % 13 = 0), count(*) FROM customer)
WHERE affected > 0""")
def missing_values(spark, sf_dir):
    df = _read(spark, sf_dir, "customer", "c_custkey", f"{SEGMENT} AS seg", "CASE WHEN c_custkey % 13 = 0 THEN double('NaN') ELSE c_acctbal END AS bal")
    found, _ = _findings(df, AuditConfig(), "_missing")
    return _summary(spark, [(f.columns[0], f.affected_count, round(f.details["fraction"], 9)) for f in found], "column_name string, affected long, fraction double")


@_query("SELECT c_custkey FROM customer WHERE c_custkey % 11 < 5")
def invalid_numeric(spark, sf_dir):
    text = "CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN 'inf' WHEN 3 THEN '1d' WHEN 4 THEN 'NaN' WHEN 5 THEN ' 1e3 ' ELSE cast(c_acctbal AS string) END AS v"
    return _rows(_read(spark, sf_dir, "customer", "c_custkey", text), AuditConfig(numeric_columns=["v"]), "_numbers", "invalid_numeric", "c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def out_of_bounds(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), AuditConfig(bounds={"c_acctbal": [0, None]}), "_numbers", "out_of_bounds", "c_custkey")


EDGES = [0, 10, 20, 30, 40, 45, 100, 200]


@_query("""
SELECT e.l AS "left", e.r AS "right", count(l_quantity)::BIGINT AS n
FROM (VALUES (0.0, 10.0, false), (10, 20, false), (20, 30, false), (30, 40, false), (40, 45, false), (45, 100, false), (100, 200, true)) e(l, r, last)
LEFT JOIN lineitem ON l_quantity >= e.l AND (l_quantity < e.r OR (e.last AND l_quantity = e.r)) GROUP BY 1, 2""".replace("e.l AS", "e.l::DOUBLE AS").replace("e.r AS", "e.r::DOUBLE AS"))
def sparse_bins(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "lineitem", "l_quantity"), AuditConfig(sparse_bins={"l_quantity": EDGES}, min_bin_count=10**9), "_bins")
    return _summary(spark, [(float(f.details["left"]), float(f.details["right"]), f.details["count"]) for f in found if f.code == "sparse_bin"], "left double, right double, n long")


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 OR l_quantity > 40")
def outside_sparse_bins(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return _rows(df, AuditConfig(sparse_bins={"l_quantity": [5, 40]}), "_bins", "outside_sparse_bins", ["l_orderkey", "l_linenumber", "l_quantity"])


@_query("SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def provenance_gap(spark, sf_dir):
    df = _read(spark, sf_dir, "documents", "doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE source END AS source")
    return _rows(df, AuditConfig(provenance_columns=["source"]), "_provenance", "provenance_gap", "doc_id")


@_query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR (doc_id % 3 <> 0 AND NOT regexp_full_match(source, 'src[0-9]')))")
def weak_provenance(spark, sf_dir):
    text = "CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 5 = 0 THEN ' ToDo ' WHEN doc_id % 3 = 0 THEN ' src4 ' ELSE source END AS source"
    return _rows(_read(spark, sf_dir, "documents", "doc_id", text), AuditConfig(provenance_patterns={"source": r"src\d"}), "_weak", "weak_provenance", "doc_id")


# groups


@_query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_samples(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "documents", "doc_id", "text"), AuditConfig(duplicate_columns=["text"]), "_duplicates", "duplicate_samples", "doc_id")


PART3 = "CASE {} % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE '' END"


@_query(f"""
WITH d AS (SELECT doc_id, text, {PART3.format('doc_id')} AS part FROM documents)
SELECT doc_id FROM d WHERE part <> '' AND text IN (SELECT text FROM d WHERE part <> '' GROUP BY text HAVING count(DISTINCT part) > 1)""")
def duplicate_split_overlap(spark, sf_dir):
    df = _read(spark, sf_dir, "documents", "doc_id", "text", f"{PART3.format('doc_id')} AS part")
    return _rows(df, AuditConfig(duplicate_columns=["text"], split_column="part"), "_duplicates", "duplicate_split_overlap", "doc_id")


ORDER_COLUMNS = ("o_orderkey", "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust", "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'train' ELSE 'test' END AS part")
ORDER_CONFIG = AuditConfig(duplicate_columns=["o_orderkey"], group_columns=["cust"], split_column="part")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def missing_split(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "orders", *ORDER_COLUMNS), ORDER_CONFIG, "_duplicates", "missing_split", "o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0")
def missing_group(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "orders", *ORDER_COLUMNS), ORDER_CONFIG, "_duplicates", "missing_group", "o_orderkey")


@_query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN 'train' ELSE 'test' END AS part FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 5 <> 0)
SELECT o_orderkey FROM o WHERE o_custkey IN (SELECT o_custkey FROM o GROUP BY 1 HAVING count(DISTINCT part) > 1)""")
def group_split_overlap(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "orders", *ORDER_COLUMNS), ORDER_CONFIG, "_duplicates", "group_split_overlap", "o_orderkey")


@_query("SELECT 'unit' AS column_name, count(*) FILTER (c_custkey % 9 <> 0) AS affected FROM customer")
def constant_column(spark, sf_dir):
    df = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'usd' END AS unit")
    found, _ = _findings(df, AuditConfig(), "_constants")
    return _summary(spark, [(f.columns[0], f.affected_count) for f in found], "column_name string, affected long")


@_query("""
SELECT column_name, round(u, 9) AS unique_fraction FROM (
  SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) / count(*) AS u FROM orders
  UNION ALL SELECT 'row_id', count(DISTINCT o_orderkey // 2) / count(*) FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) / count(*) FROM orders) WHERE u >= 0.9""")
def suspicious_identifier(spark, sf_dir):
    df = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderkey div 2 AS row_id", "o_custkey")
    found, _ = _findings(df, AuditConfig(identifier_columns=["o_orderkey", "o_custkey"], feature_columns=["row_id"]), "_identifiers")
    return _summary(spark, [(f.columns[0], round(f.details["unique_fraction"], 9)) for f in found], "column_name string, unique_fraction double")


FEATURES = ("l_quantity AS target", "CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity END AS copied", "2 * l_quantity + 1 AS proxy", "l_extendedprice AS price", "l_discount AS later")
FEATURE_CONFIG = AuditConfig(feature_columns=["target", "copied", "proxy", "price", "later"], target_column="target", unavailable_features=["later"])


@_query("SELECT 'copied' AS feature, count(*) FILTER (l_orderkey % 6 <> 0) AS affected FROM lineitem")
def target_copy(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "lineitem", *FEATURES), FEATURE_CONFIG, "_features")
    return _summary(spark, [(f.columns[0], f.affected_count) for f in found if f.code == "target_copy"], "feature string, affected long")


@_query("SELECT unnest(['target', 'later']) AS feature, count(*) AS affected FROM lineitem")
def unavailable_feature(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "lineitem", *FEATURES), FEATURE_CONFIG, "_features")
    return _summary(spark, [(f.columns[0], f.affected_count) for f in found if f.code == "unavailable_feature"], "feature string, affected long")


@_query("SELECT 'copied' AS feature, count(*) FILTER (l_orderkey % 6 <> 0) AS affected, 1.0::DOUBLE AS r FROM lineitem UNION ALL SELECT 'proxy', count(*), 1.0 FROM lineitem")
def target_proxy(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "lineitem", *FEATURES), FEATURE_CONFIG, "_proxies")
    return _summary(spark, [(f.columns[0], f.affected_count, round(f.details["pearson_r"], 6)) for f in found], "feature string, affected long, r double")


@_query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2
HAVING count(*) > 1 AND max(l_quantity) - min(l_quantity) > 5""")
def conflicting_samples(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    a = Audit(bind(df), AuditConfig(identity_columns=["l_orderkey", "l_linenumber"], conflict_columns=["l_quantity"], conflict_tolerance=5))
    return a.conflicting_groups().select(F.col("k0").alias("l_orderkey"), F.col("k1").alias("l_linenumber"), "n")


# units

UNIT = "CASE s_suppkey % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'degC' WHEN 2 THEN 'm' WHEN 3 THEN 'mystery' WHEN 4 THEN NULL ELSE 'mK' END"
UNIT_CONFIG = {"units": {"v": {"column": "u", "expected": "K"}}}


@_query(f"""
WITH s AS (SELECT s_suppkey, {UNIT} AS u FROM supplier)
SELECT code, n FROM (
  SELECT 'missing_unit' AS code, count(*) FILTER (u IS NULL) AS n FROM s
  UNION ALL SELECT 'unit_mismatch', count(*) FILTER (u <> 'K') FROM s
  UNION ALL SELECT 'unit_conversion:degC', count(*) FILTER (u = 'degC') FROM s
  UNION ALL SELECT 'unit_conversion:mK', count(*) FILTER (u = 'mK') FROM s
  UNION ALL SELECT 'incompatible_units', count(*) FILTER (u = 'm') FROM s
  UNION ALL SELECT 'unknown_unit', count(*) FILTER (u = 'mystery') FROM s) WHERE n > 0""")
def unit_findings(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal AS v", f"{UNIT} AS u"), AuditConfig(**UNIT_CONFIG), "_units")
    return _summary(spark, [(f.code + (f":{f.details['from']}" if "from" in f.details else ""), f.affected_count) for f in found], "code string, n long")


@_query("SELECT 'missing_unit_column' AS code, count(*) AS n FROM supplier")
def missing_unit_column(spark, sf_dir):
    found, _ = _findings(_read(spark, sf_dir, "supplier", "s_acctbal AS v"), AuditConfig(**UNIT_CONFIG), "_units")
    return _summary(spark, [(f.code, f.affected_count) for f in found], "code string, n long")


@_query(f"""
SELECT s_suppkey, round(CASE u WHEN 'K' THEN s_acctbal WHEN 'degC' THEN s_acctbal + 273.15 WHEN 'mK' THEN s_acctbal / 1000 END, 6) AS kelvin
FROM (SELECT *, {UNIT} AS u FROM supplier)""")
def unit_conversion(spark, sf_dir):
    a = Audit(bind(_read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal AS v", f"{UNIT} AS u")), AuditConfig(**UNIT_CONFIG))
    return a.t.df.select(a.t.col("s_suppkey").alias("s_suppkey"), F.round(a.number("v"), 6).alias("kelvin"))


# rules


def _rule(spark, sf_dir, table: str, columns: tuple[str, ...], rule: dict, key: str | list[str], code: str = "constraint_violation") -> DataFrame:
    return _rows(_read(spark, sf_dir, table, *columns), AuditConfig(rules=[{"name": "rule"} | rule]), "_rules", code, key)


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice < 1000 * (o_orderkey % 100)")
def rule_compare(spark, sf_dir):
    return _rule(spark, sf_dir, "orders", ("o_orderkey", "o_totalprice", "1000 * (o_orderkey % 100) AS floor"), {"assert": {"column": "o_totalprice", "op": "ge", "other_column": "floor"}}, "o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus >= 'O'")
def rule_string(spark, sf_dir):
    return _rule(spark, sf_dir, "orders", ("o_orderkey", "o_orderstatus"), {"assert": {"column": "o_orderstatus", "op": "lt", "value": "O", "kind": "string"}}, "o_orderkey")


@_query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)")
def rule_in(spark, sf_dir):
    return _rule(spark, sf_dir, "customer", ("c_custkey", "c_nationkey"), {"assert": {"column": "c_nationkey", "op": "in", "value": [1, "2", 3.0]}}, "c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rule_not_in(spark, sf_dir):
    return _rule(spark, sf_dir, "customer", ("c_custkey", "c_mktsegment"), {"assert": {"column": "c_mktsegment", "op": "not_in", "value": ["BUILDING", "MACHINERY"], "kind": "string"}}, "c_custkey")


@_query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def rule_temporal(spark, sf_dir):
    return _rule(spark, sf_dir, "events", ("event_id", "ts"), {"assert": {"column": "ts", "op": "before", "value": "2024-01-15T14:00:00+02:00"}}, "event_id")


@_query("SELECT p_partkey FROM part WHERE NOT (p_size >= 10 AND p_retailprice <= 930)")
def rule_all(spark, sf_dir):
    return _rule(spark, sf_dir, "part", ("p_partkey", "p_size", "p_retailprice"), {"assert": {"all": [{"column": "p_size", "op": "ge", "value": 10}, {"column": "p_retailprice", "op": "le", "value": 930}]}}, "p_partkey")


@_query("SELECT p_partkey FROM part WHERE NOT (p_size >= 40 OR p_retailprice <= 910)")
def rule_any(spark, sf_dir):
    return _rule(spark, sf_dir, "part", ("p_partkey", "p_size", "p_retailprice"), {"assert": {"any": [{"column": "p_size", "op": "ge", "value": 40}, {"column": "p_retailprice", "op": "le", "value": 910}]}}, "p_partkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000")
def rule_when(spark, sf_dir):
    return _rule(spark, sf_dir, "orders", ("o_orderkey", "o_orderstatus", "o_totalprice"), {"when": {"column": "o_orderstatus", "op": "eq", "value": "F", "kind": "string"}, "assert": {"column": "o_totalprice", "op": "ge", "value": 100000}}, "o_orderkey")


@_query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 = 1 END AS w, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal > 0 END AS a FROM supplier)
SELECT s_suppkey FROM s WHERE w IS NULL OR (w AND a IS NULL)""")
def rule_unknown(spark, sf_dir):
    columns = ("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 END AS w", "CASE WHEN s_suppkey % 5 = 0 THEN 'inf' ELSE cast(s_acctbal AS string) END AS a")
    return _rule(spark, sf_dir, "supplier", columns, {"when": {"column": "w", "op": "eq", "value": 1}, "assert": {"column": "a", "op": "gt", "value": 0}}, "s_suppkey", "constraint_not_evaluable")


SHARES = ("p_partkey", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE double(p_size) END AS a", "CASE WHEN p_partkey % 7 = 0 THEN double(101 - p_size) WHEN p_partkey % 11 = 0 THEN double(-p_size) ELSE double(100 - p_size) END AS b")


@_query("""
SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size::DOUBLE END AS a,
  CASE WHEN p_partkey % 7 = 0 THEN 101.0 - p_size WHEN p_partkey % 11 = 0 THEN 0.0 - p_size ELSE 100.0 - p_size END AS b FROM part)
WHERE a < 0 OR (a IS NOT NULL AND b < 0) OR abs(a + b - 100) > 0.000001""")
def composition_error(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "part", *SHARES), AuditConfig(compositions=[{"columns": ["a", "b"]}]), "_rules", "composition_error", "p_partkey")


@_query("SELECT p_partkey FROM part WHERE p_partkey % 13 = 0")
def composition_not_evaluable(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "part", *SHARES), AuditConfig(compositions=[{"columns": ["a", "b"]}]), "_rules", "composition_not_evaluable", "p_partkey")


# pairs

PRICES = ("p_partkey", "CASE WHEN p_partkey % 37 = 0 THEN double('Infinity') ELSE p_retailprice END AS price", "p_size", f"{PART3.format('p_partkey')} AS part")
PRICE_SQL = f"p AS (SELECT p_partkey, p_retailprice AS price, p_size, {PART3.format('p_partkey')} AS part FROM part WHERE p_partkey % 37 <> 0)"
MANY = 10**18


@_query(f"""
WITH {PRICE_SQL}, q AS (SELECT a.p_partkey AS i, b.p_partkey AS j, a.part AS x, b.part AS y FROM p a JOIN p b ON a.p_partkey < b.p_partkey AND abs(a.price - b.price) <= 0.5 AND abs(a.p_size - b.p_size) <= 1)
SELECT code, n_pairs, n_rows FROM (
  SELECT 'near_duplicate_samples' AS code, (SELECT count(*) FROM q) AS n_pairs, (SELECT count(*) FROM (SELECT i FROM q UNION SELECT j FROM q)) AS n_rows
  UNION ALL SELECT 'near_duplicate_split_overlap', (SELECT count(*) FROM q WHERE x <> '' AND y <> '' AND x <> y), (SELECT count(*) FROM (SELECT i FROM q WHERE x <> '' AND y <> '' AND x <> y UNION SELECT j FROM q WHERE x <> '' AND y <> '' AND x <> y))
) WHERE n_pairs > 0""")
def near_duplicate_findings(spark, sf_dir):
    config = AuditConfig(near_duplicates={"price": 0.5, "p_size": 1}, split_column="part", max_pair_comparisons=MANY)
    found, _ = _findings(_read(spark, sf_dir, "part", *PRICES), config, "_near")
    rows = [(f.code, f._known["pair_count"], f.affected_count) for f in found if "pair_count" in f._known]
    return _summary(spark, rows, "code string, n_pairs long, n_rows long")


@_query("SELECT p_partkey FROM part WHERE p_partkey % 37 = 0")
def similarity_not_evaluable(spark, sf_dir):
    config = AuditConfig(near_duplicates={"price": 0.5, "p_size": 0}, max_pair_comparisons=MANY)
    return _rows(_read(spark, sf_dir, "part", *PRICES), config, "_near", "similarity_not_evaluable", "p_partkey")


@_query("""
WITH p AS (SELECT s_suppkey, s_acctbal / 500 AS x, s_nationkey / 2 AS y FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT a.s_suppkey, count(b.s_suppkey) AS neighbours FROM p a LEFT JOIN p b ON a.s_suppkey <> b.s_suppkey AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1 GROUP BY 1""")
def density(spark, sf_dir):
    own = _read(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0").selectExpr(f"s_suppkey AS {ROW}", "s_acctbal / 500 AS x0", "s_nationkey / 2 AS x1")
    return neighbour_counts(own, ["x0", "x1"], 1.0).select(F.col(ROW).alias("s_suppkey"), "neighbours")


@_query("""
WITH p AS (SELECT s_suppkey, s_acctbal / 500 AS x, s_nationkey / 2 AS y FROM supplier WHERE s_suppkey % 9 <> 0),
c AS (SELECT a.s_suppkey, count(b.s_suppkey) AS n FROM p a LEFT JOIN p b ON a.s_suppkey <> b.s_suppkey AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1 GROUP BY 1)
SELECT s_suppkey FROM c WHERE n < 2""")
def sparse_neighborhood(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "supplier", *_DENSE), _DENSITY, "_density", "sparse_neighborhood", "s_suppkey")


_DENSE = ("s_suppkey", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS x", "s_nationkey AS y")
_DENSITY = AuditConfig(density_columns=["x", "y"], density_scales={"x": 500, "y": 2}, min_neighbors=2, max_pair_comparisons=MANY)


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 = 0")
def density_not_evaluable(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "supplier", *_DENSE), _DENSITY, "_density", "density_not_evaluable", "s_suppkey")


# splits


def _split(df: DataFrame, key: str, config: SplitConfig) -> DataFrame:
    """Labels by key; rows are numbered in order of the key."""
    table = bind(df, order_by=key)
    from tidemark.operators.split import Splitter

    labels = Splitter(table, config).result().assignments_df
    return labels.join(table.df.select(ROW, table.col(key).alias(key)), ROW).select(key, "label")


_HELD = ", ".join(map(str, held_ranks(25, 0.3, 7)))
_SEEDED = f"""
WITH g AS (SELECT c_nationkey AS k, rank() OVER (ORDER BY min(c_custkey)) - 1 AS r FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN r IN ({_HELD}) THEN 'test' ELSE 'train' END AS label FROM customer JOIN g ON k = c_nationkey"""


@_query(_SEEDED)
def split_laboratory(spark, sf_dir):
    return _split(_read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), "c_custkey", SplitConfig("laboratory", ["c_nationkey"], test_size=0.3, seed=7))


@_query(_SEEDED)
def split_composition(spark, sf_dir):
    df = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey AS a", "c_nationkey % 5 AS b")
    return _split(df, "c_custkey", SplitConfig("composition", ["a", "b"], test_size=0.3, seed=7))


@_query("SELECT c_custkey, CASE WHEN c_nationkey IN (3, 7) THEN 'test' ELSE 'train' END AS label FROM customer")
def split_laboratory_explicit(spark, sf_dir):
    return _split(_read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), "c_custkey", SplitConfig("laboratory", ["c_nationkey"], holdout_values=[3, 7]))


@_query("SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-15' THEN 'test' ELSE 'train' END AS label FROM events")
def split_time(spark, sf_dir):
    return _split(_read(spark, sf_dir, "events", "event_id", "ts"), "event_id", SplitConfig("time", ["ts"], cutoff="2024-01-15"))


@_query("""
WITH e AS (SELECT event_id, event_id // 3 AS g, CASE WHEN ts > TIMESTAMP '2024-01-15' THEN 'test' ELSE 'train' END AS label FROM events)
SELECT event_id, CASE WHEN count(DISTINCT label) OVER (PARTITION BY g) > 1 THEN 'excluded' ELSE label END AS label FROM e""")
def split_time_exclude(spark, sf_dir):
    df = _read(spark, sf_dir, "events", "event_id", "ts", "event_id div 3 AS g")
    return _split(df, "event_id", SplitConfig("time", ["ts"], ["g"], cutoff="2024-01-15", crossing_policy="exclude"))


@_query("SELECT p_partkey, CASE WHEN p_retailprice > 910 THEN 'test' ELSE 'train' END AS label FROM part")
def split_extrapolation_high(spark, sf_dir):
    return _split(_read(spark, sf_dir, "part", "p_partkey", "p_retailprice"), "p_partkey", SplitConfig("extrapolation", ["p_retailprice"], threshold=910))


@_query("SELECT p_partkey, CASE WHEN p_retailprice < 910 THEN 'test' ELSE 'train' END AS label FROM part")
def split_extrapolation_low(spark, sf_dir):
    return _split(_read(spark, sf_dir, "part", "p_partkey", "p_retailprice"), "p_partkey", SplitConfig("extrapolation", ["p_retailprice"], threshold=910, direction="low"))


@_query("""
SELECT n_train, n_test, 0::BIGINT AS n_excluded, low, high FROM (
  SELECT count(*) FILTER (p_retailprice <= 910) AS n_train, count(*) FILTER (p_retailprice > 910) AS n_test,
    min(p_retailprice) FILTER (p_retailprice > 910) AS low, max(p_retailprice) FILTER (p_retailprice > 910) AS high FROM part)""")
def split_diagnostics(spark, sf_dir):
    d = split(_read(spark, sf_dir, "part", "p_partkey", "p_retailprice"), SplitConfig("extrapolation", ["p_retailprice"], threshold=910)).diagnostics
    return _summary(spark, [(d["n_train"], d["n_test"], d["n_excluded"], *d["observed_ranges"]["test"])], "n_train long, n_test long, n_excluded long, low double, high double")


@_query("""
WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_nationkey AS a, s_suppkey // 2 AS b FROM supplier),
s AS (SELECT DISTINCT x.id AS u, y.id AS v FROM n x JOIN n y ON x.a = y.a OR x.b = y.b),
r AS (SELECT id, id AS c FROM n UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id)
SELECT id AS s_suppkey, min(c) AS component FROM r GROUP BY 1""")
def components_of_suppliers(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").selectExpr(f"s_suppkey AS {ROW}", "s_nationkey AS a", "s_suppkey div 2 AS b")
    return row_components(rows, [["a"], ["b"]]).select(F.col(ROW).alias("s_suppkey"), "component")


# other


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def preset_batteries(spark, sf_dir):
    return _rows(_read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), preset("batteries", {"capacity": "c_acctbal"}), "_numbers", "out_of_bounds", "c_custkey")


@_query("""
SELECT c_custkey, coalesce(list_aggregate([x FOR x IN [CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'missing_values:seg' END, CASE WHEN c_acctbal < 0 THEN 'out_of_bounds:c_acctbal' END] IF x IS NOT NULL], 'string_agg', ','), '') AS found FROM customer""")
def row_violations(spark, sf_dir):
    df = _read(spark, sf_dir, "customer", "c_custkey", f"{SEGMENT} AS seg", "c_acctbal")
    return violations(df, AuditConfig(bounds={"c_acctbal": [0, None]})).select("c_custkey", F.array_join("violations", ",").alias("found"))
