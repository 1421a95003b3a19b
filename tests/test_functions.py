import itertools
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cells, predicates, units


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_missing_is_null_nan_or_any_white_space(spark):
    df = column(spark, [None, "", " ", "\t\n", " ", "　", "\x1c", "x", " x ", "NaN"])
    assert out(df, cells.missing(F.col("v"), T.StringType())) == [True] * 7 + [False] * 3
    df = column(spark, [None, float("nan"), float("inf"), 0.0], "double")
    assert out(df, cells.missing(F.col("v"), T.DoubleType())) == [True, True, False, False]


@pytest.mark.parametrize("text,value", [(" 1 ", 1.0), ("+5", 5.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("inf", None), ("-Infinity", None), ("nan", None), ("1d", None), ("1f", None), ("0x1p3", None), ("1_000", None), ("1,000", None), ("1 2", None), ("", None), ("True", None), ("1e400", None)])
def test_numbers_are_read_strictly(spark, text, value):
    assert out(column(spark, [text]), cells.number(F.col("v"), T.StringType())) == [value]


def test_booleans_and_times_are_no_measurements():
    with pytest.raises(ValueError, match="boolean"):
        cells.number(F.lit(True), T.BooleanType(), "x")
    with pytest.raises(ValueError, match="temporal"):
        cells.number(F.current_timestamp(), T.TimestampType(), "x")


def test_absolute_times(spark):
    texts = ["2025-01-01", "2025-01-01T00:00:00Z", "2024-12-31 19:00:00-05:00", "2024-12-31T19:00-0500", "2025-01-01 00:00", "today", "2025-01-01 00:00:00 America/New_York", "2025-13-01", "1", None]
    got = out(column(spark, texts), F.unix_seconds(cells.instant(F.col("v"), T.StringType())))
    assert got == [1735689600] * 5 + [None] * 5


def test_full_match_follows_python(spark):
    df = column(spark, ["10.1/a", "10.1/a\n", "x10.1/a", "٣", None])
    assert out(df, cells.full_match(F.col("v"), r"10\.\d+/.+")) == [True, False, False, False, None]
    assert out(df, cells.full_match(F.col("v"), r"\d")) == [False, False, False, True, None]
    assert out(df, cells.full_match(F.col("v"), r"(?P<n>10)\.1/a\Z")) == [True, False, False, False, None]


def test_lines_end_as_in_python(spark):
    patterns = ["a.b", "a.*", ".", "a$", "a.$", "^a.b$", r"a\sb", r"a[^x]b", r"(a|b).?", r"\w.\w", "a\nb", r"a.b\n?"]
    texts = [f"a{c}b" for c in ("\r", "\n", "\r\n", "\x85", "\u2028", "\u2029", "\x0b", "\x0c", "x", "")] + ["a\n", "a\r", "a\x85", "\u2028", "\r", "\n", "", "ab\n", "a.b\n"]
    df = column(spark, texts)
    for p in patterns:
        assert out(df, cells.full_match(F.col("v"), p)) == [re.fullmatch(p, t) is not None for t in texts], p


def test_rules_are_three_valued(spark):
    values = [True, False, None]
    cell = {True: 1, False: 0, None: None}
    df = spark.createDataFrame([(i, cell[a], cell[b]) for i, (a, b) in enumerate(itertools.product(values, values))], "i int, a int, b int")
    look = lambda n: (F.col(n), T.IntegerType())
    parts = [{"column": c, "op": "eq", "value": 1} for c in "ab"]
    kleene_and = lambda a, b: False if a is False or b is False else None if a is None or b is None else True
    kleene_or = lambda a, b: True if a or b else None if a is None or b is None else False
    for word, truth in (("all", kleene_and), ("any", kleene_or)):
        assert out(df, predicates.compile_rule({word: parts}, look)) == [truth(a, b) for a, b in itertools.product(values, values)]


def test_rule_operators(spark):
    df = spark.createDataFrame([(0, "2", "b", "2025-01-01"), (1, "x", " ", "bad")], "i int, n string, s string, t string")
    look = lambda n: (F.col(n), T.StringType())
    cases = [
        ({"column": "n", "op": "ge", "value": "2"}, [True, None]),
        ({"column": "n", "op": "in", "value": [1, "2.0"]}, [True, None]),
        ({"column": "n", "op": "not_in", "value": [2]}, [False, None]),
        ({"column": "s", "op": "lt", "value": "c", "kind": "string"}, [True, None]),
        ({"column": "s", "op": "not_in", "value": ["a"], "kind": "string"}, [True, None]),
        ({"column": "t", "op": "on_or_before", "value": "2025-01-01T00:00:00Z"}, [True, None]),
        ({"column": "t", "op": "after", "value": 5}, [None, None]),
    ]
    for rule, expected in cases:
        predicates.validate(rule)
        assert out(df, predicates.compile_rule(rule, look)) == expected, rule


def nested(levels):
    rule = {"column": "x", "op": "eq", "value": 1}
    for _ in range(levels):
        rule = {"all": [rule]}
    return rule


def test_rule_depth():
    predicates.validate(nested(8))
    with pytest.raises(ValueError, match="levels"):
        predicates.validate(nested(9))


@pytest.mark.parametrize("rule", [
    [], {}, {"all": []}, {"all": [nested(0)], "any": [nested(0)]}, {"column": "", "op": "eq", "value": 1}, {"column": "x", "op": "eval", "value": 1},
    {"column": "x", "op": "eq"}, {"column": "x", "op": "eq", "value": 1, "other_column": "y"}, {"column": "x", "op": "eq", "value": [1]}, {"column": "x", "op": "in", "value": []},
    {"column": "x", "op": "in", "value": 1}, {"column": "x", "op": "eq", "value": True}, {"column": "x", "op": "eq", "value": "NaN"}, {"column": "x", "op": "ge", "value": 10**400},
    {"column": "x", "op": "eq", "value": 1, "kind": "date"}, {"column": "x", "op": "eq", "value": 1, "more": 2}, {"column": "x", "op": [], "value": 1},
])
def test_wrong_rules(rule):
    with pytest.raises(ValueError):
        predicates.validate(rule)


@pytest.mark.parametrize("source,target,value,expected", [
    ("degC", "K", 25, 298.15), ("K", "degC", 0, -273.15), ("degF", "degC", 212, 100), ("mmol/L", "mol/L", 1000, 1), ("bar", "Pa", 2, 2e5), ("mAh", "C", 1, 3.6),
    ("g/cm**3", "kg/m^3", 1, 1000), ("kJ/mol", "J/mol", 1, 1000), ("min", "s", 2, 120), ("(m/s)**2", "J/kg", 3, 3), ("mA/cm**2", "A/m**2", 1, 10), ("M", "mmol/L", 1, 1000), ("percent", "dimensionless", 50, 0.5), ("millimeter", "m", 5, 0.005),
])
def test_unit_conversion(source, target, value, expected):
    scale, offset = units.conversion(source, target)
    assert value * scale + offset == pytest.approx(expected)


def test_units_that_differ_or_are_unknown():
    assert units.conversion("m", "K") is None
    assert units.conversion("C", "K") is None  # coulomb
    for text in ("mystery", "", "m//s", "degC/s", "m**", "k", "(m"):
        with pytest.raises(units.UnknownUnit):
            units.parse(text)


@pytest.mark.parametrize("source,target,value,expected", [("gallon", "L", 2, 7.570823568), ("yd", "m", 10, 9.144), ("cP", "Pa*s", 1, 0.001), ("degR", "K", 491.67, 273.15), ("kDa", "kg", 1, 1.6605390666e-24), ("rpm", "rad/s", 60, 6.283185307), ("MBq", "1/s", 3, 3e6), ("nkat", "mol/s", 5, 5e-9), ("delta_degC", "K", 7, 7), ("hp", "W", 1, 745.6998716), ("hectare", "m^2", 1, 1e4), ("year", "day", 1, 365.25), ("ppb", "ppm", 1000, 1), ("kgf", "N", 1, 9.80665), ("mSv", "J/kg", 4, 0.004), ("min", "s", 2, 120), ("ha", "acre", 1, 2.4710538147)])
def test_units_of_laboratory_and_trade(source, target, value, expected):
    scale, offset = units.conversion(source, target)
    assert value * scale + offset == pytest.approx(expected, rel=1e-8)
