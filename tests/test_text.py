"""Text and number rules against plain Python."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from remitra.config import values
from remitra.checks import catalog
from remitra.checks.inputs import workspace
from remitra.functions import numbers, text
from remitra.operators import names

BLANKS = ["a b", " x ", "　y ", "\tz\n", " \t ", "", None, "'x", "' '", "''q", "\x1cw\x85"]
NAMES = [
    "LAO CO., LTD", "  .Acme-/ ", "NULL", "0010-0182 6211", "12345", "中国银行", "ທະນາຄານ", "ab", "x\ty",
    "Café du Nord", "---", "nil", "A B  C", None, "", "ຊື່ ຜູ້ໂອນ", "ÃÂ plain", "N/A",
]


def column(spark, items, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    rows = df.select("i", make(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def damage(s):
    """UTF-8 bytes read as code page 1252, undefined bytes passed through."""
    table = {ord(b): ord(c) for b, c in zip(text.CP1252_BYTES, text.CP1252)}
    return "".join(chr(table.get(b, b)) for b in s.encode("utf-8"))


def repaired(s):
    if not s or not re.search(text.SUSPECT, s):
        return s
    back = {ord(c): ord(b) for b, c in zip(text.CP1252_BYTES, text.CP1252)}
    codes = [back.get(ord(ch), ord(ch)) for ch in s]
    if max(codes) > 0xFF:
        return s
    try:
        out = bytes(codes).decode("utf-8")
    except UnicodeDecodeError:
        return s
    return s if re.search(text.STILL_WRONG, out) else out


def normal(s):
    return None if s is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", s)).strip() or None


def cleaned(s):
    s = normal(repaired(s)) if s else None
    return s and (s.strip(text.NAME_EDGE) or None)


def test_code_page_table():
    assert text.CP1252_BYTES.encode("latin-1").decode("cp1252") == text.CP1252


def test_space_trim(spark):
    zs = "".join(chr(c) for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs")
    assert sorted(text.SPACES) == sorted(zs)
    assert column(spark, BLANKS, text.zs_trim) == [v if v is None else v.strip(zs) for v in BLANKS]


def test_strip_is_pythons(spark):
    assert column(spark, BLANKS, text.strip) == [v if v is None else v.strip() for v in BLANKS]
    assert all(chr(c).isspace() == (chr(c) in text.BLANKS) for c in range(0x3100))


def test_clean_text(spark):
    def expected(v):
        s = (v or "").strip()
        return (s[1:].strip() if s.startswith("'") else s) or None

    assert column(spark, BLANKS, text.clean_text) == [expected(v) for v in BLANKS]


def test_mojibake(spark):
    lao = ["ຊື່ຜູ້ໂອນ", "ທະນາຄານ ການຄ້າ", "ໄທ"]
    items = lao + [damage(s) for s in lao] + [damage("déjà"), damage("é è"), "Ã plain", "plain", "â€", None, ""]
    assert column(spark, items, text.fix_mojibake) == [repaired(s) for s in items]
    assert column(spark, [damage(s) for s in lao], text.fix_mojibake) == lao


def test_names(spark):
    items = NAMES + [damage(s) for s in NAMES if s]
    assert column(spark, items, text.norm_text) == [normal(s) for s in items]
    assert column(spark, items, text.clean_name) == [cleaned(s) for s in items]


def test_real_names(spark):
    block = values.PLACEHOLDER_NAMES

    def real(s):
        for form in (s, cleaned(s)):
            v = (form or "").strip()
            if len(v) < 3 or v.upper() in block or v.isdigit() or not any(c.isalpha() for c in v):
                return False
        return True

    got = column(spark, NAMES, lambda c: text.real_name(c, text.clean_name(c), block))
    assert got == [real(s) for s in NAMES]
    by_name = dict(zip(NAMES, got))
    assert not by_name["NULL"] and not by_name["0010-0182 6211"] and by_name["中国银行"]


def test_named_needs_latin_or_lao(spark):
    got = dict(zip(NAMES, column(spark, NAMES, text.named)))
    assert not got["中国银行"] and got["ທະນາຄານ"] and not got["12345"] and not got["ab"]


def test_bank_key(spark):
    items = ["b.c-el 1", "ທະ-ນາ", " x_y ", "Ä/ö", "ກໍາ ໄລ"]
    expected = ["".join(ch for ch in s.upper() if ch.isalnum()) for s in items]
    # Combining marks are neither letters nor digits on either side.
    assert column(spark, items, text.bank_key) == expected


def test_title_case(spark):
    got = column(spark, ["PAK LAY EDL POWER", "opd x"], lambda c: text.title_case(c, ["EDL", "OPD"]))
    assert got == ["Pak Lay EDL Power", "opd X"]


@pytest.mark.parametrize("commas", [True, False])
def test_to_num(spark, commas):
    items = ["1,234.50", "12", " 7.5 ", "1e3", "x", "", None, "1d", "-3", ".5", "5."]

    def expected(v):
        try:
            return float(v.replace(",", "") if commas else v)
        except (AttributeError, TypeError, ValueError):
            return None

    assert column(spark, items, lambda c: numbers.to_num(c, commas)) == [expected(v) for v in items]


def test_locale_numbers(spark):
    items = ["22.558", "673,20", "22,489", "672.61", "1.234,5 kip", "", "n/a", "-5"]
    assert column(spark, items, numbers.num_eu) == [22558, 673.2, 22.489, 67261, 1234.5, None, None, -5]
    assert column(spark, items, numbers.num_en) == [22.558, 67320, 22489, 672.61, 1.2345, None, None, -5]


def test_rounding(spark):
    df = spark.createDataFrame([(None,), (-0.0001,), (1.2345,), (1.23449999999999,), (-2.5e-9,)], "v double")
    assert [r[0] for r in df.select(numbers.r2(F.col("v"))).collect()] == [0.0, 0.0, 1.235, 1.235, 0.0]


def test_python_number(spark):
    items = [0.0, 1.0, 1234567.25, 1e7, 0.1, 123456789012.34, -5.5, 9.99e15]
    df = spark.createDataFrame([(v,) for v in items], "v double")
    assert [r[0] for r in df.select(numbers.python_number(F.col("v"))).collect()] == [str(v) for v in items]


def test_clean_names_of_long_tables(spark):
    """The same as the column form, without a scalar Python function, whose input queue goes to disk whole."""
    items = [*NAMES, "étude", "Café ́.", "각", damage("Café")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    long = names.with_clean_names(df, {"a": F.col("v"), "b": F.concat(F.lit("./"), F.col("v"))})
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    rows = sorted(long.collect())
    assert [r.v for r in rows] == items
    assert [r.a for r in rows] == [cleaned(v) for v in items] == column(spark, items, text.clean_name)
    assert [r.b for r in rows] == [v if v is None else cleaned("./" + v) for v in items]


def test_distinct_names_are_cleaned_without_a_queue(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("P13_clean_name", "P17_real_name"):
        plan = catalog.QUERIES[name](workspace(spark, folder))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "EvalPython" not in plan


def test_only_names_that_repair_changes_are_joined(spark):
    """A list of all names would be too long to broadcast and move every row."""
    items = [*NAMES, damage("Café"), *[f"Company {k:05d}" for k in range(3000)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        real = names.only_real_names(df, "v", "name", ["NULL"])
        clean = names.with_clean_name(df, "v", "name")
        for joined in (real, clean):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert joined.columns == ["i", "v", "name"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tests = column(spark, items, lambda c: text.real_name(c, text.clean_name(c), ["NULL"]))
    assert sorted(real.collect()) == [(i, v, cleaned(v)) for i, v in enumerate(items) if v is not None and tests[i]]
    assert sorted(clean.collect()) == [(i, v, cleaned(v)) for i, v in enumerate(items)]
