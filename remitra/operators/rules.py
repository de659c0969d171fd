"""Declared rules compiled to one CASE expression, evaluated in the scan.

Readings that the declarations leave open: several words in a remark or name
condition mean any of them, texts are compared ignoring case, and the flag
rules read the purpose that the purpose rules have settled on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitra.config import rules as R
from remitra.config.declared import Rules
from remitra.operators.scale import digest_bits, with_bit
from remitra.session import stage

# What a rule condition is tested against: condition name -> column of the input.
FIELDS = {
    "bank": "bank", "flow": "flow", "country": "country", "purpose": "purpose",
    "sector": "sector", "name": "name", "remark": "remark",
}


def _text(field: str) -> Column:
    return F.col(f"_{field}")


def _with_texts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The tested texts, trimmed and upper-cased once per row rather than once per condition."""
    return df.withColumns({
        f"_{field}": F.upper(F.coalesce(F.trim(F.col(column)), F.lit("")))
        for field, column in fields.items()
    })


def decide(df: DataFrame, name: str, value: Column, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Add the outcome of compiled rules as column ``name``."""
    return _with_texts(df, fields).withColumn(name, value).drop(*[f"_{f}" for f in fields])


def _any(tests: Sequence[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _bank(value) -> Column:
    if value == "All":
        return F.lit(True)
    if isinstance(value, str) and value.startswith("!"):
        return _text("bank") != value[1:]
    return _text("bank").isin(*_listed(value))


def _starts(field: str) -> Callable:
    return lambda value: _any([_text(field).startswith(v) for v in value])


def _contains(field: str) -> Callable:
    return lambda value: _any([_text(field).contains(v.upper()) for v in value])


TESTS: dict[str, Callable] = {
    "bank": _bank,
    "flow": lambda v: F.lit(True) if v == "both" else _text("flow") == v.upper(),
    "country": lambda v: _text("country") == v,
    "purposePrefix": _starts("purpose"),
    "purposeEquals": lambda v: _text("purpose").isin(*v),
    "sectorPrefix": _starts("sector"),
    "nameContains": _contains("name"),
    "remarkContains": _contains("remark"),
    "anyOf": lambda v: _any([condition(option) for option in v]),
}


def condition(rule: dict) -> Column:
    """All conditions of a rule together; a rule without any holds for every row."""
    unknown = set(rule) - set(TESTS) - {"id", "action", "to", "value", "default"}
    if unknown:
        raise ValueError(f"unknown condition {', '.join(sorted(unknown))} in {rule}")
    holds = F.lit(True)
    for key, test in TESTS.items():
        if key in rule:
            holds = holds & test(rule[key])
    return holds


def compile_rules(
    rules: Sequence[dict], outcome: Callable[[dict], Column], default: Column | None = None,
) -> Column:
    """First match wins; without a match ``default``. To be evaluated by ``decide``."""
    chain = None
    for rule in rules:
        holds, value = condition(rule), outcome(rule)
        chain = F.when(holds, value) if chain is None else chain.when(holds, value)
    return chain if default is None else chain.otherwise(default)


def rule_hit(df: DataFrame, rules: Sequence[dict], name: str = "rule") -> DataFrame:
    """Which rule decided a row."""
    return decide(df, name, compile_rules(rules, lambda rule: F.lit(rule["id"])))


def purpose_transform(df: DataFrame, rules: Sequence[dict] = R.PURPOSE_RULES) -> DataFrame:
    """``final_purpose``: the filed purpose, kept or replaced."""
    outcome = lambda r: F.lit(r["to"]) if r["action"] == "set" else F.col("purpose")
    return decide(df, "final_purpose", compile_rules(rules, outcome, F.col("purpose")))


def _reading(purpose: str) -> dict[str, str]:
    return {**FIELDS, "purpose": purpose}


def m2_flag(
    df: DataFrame, purpose: str = "final_purpose", force_yes: Sequence[dict] = R.M2_FORCE_YES, set_no: Sequence[dict] = R.M2_SET_NO,
) -> DataFrame:
    """Yes where forced, else No where a rule says so, else Yes."""
    forced = _any([condition(rule) for rule in force_yes])
    refused = _any([condition(rule) for rule in set_no])
    flag = F.when(forced, "Yes").when(refused, "No").otherwise("Yes")
    return decide(df, "m2_rule", flag, _reading(purpose))


def use_flag(
    df: DataFrame, rules: Sequence[dict] = R.USE_RULES, purpose: str = "final_purpose",
) -> DataFrame:
    """Yes, or the label that says why a record is left out."""
    def outcome(rule: dict) -> Column:
        before, found, after = rule["value"].partition("{bank}")
        if not found:
            return F.lit(before)
        return F.concat(F.lit(before), _text("bank"), F.lit(after))

    return decide(df, "use_rule", compile_rules(rules, outcome), _reading(purpose))


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections, keyed by direction and row, win over every rule.

    Only rows that may have one are joined; a table of bits of the corrected
    keys tells which. ``df`` is read twice. Corrections compress to a small part
    of what they take in memory, so they are never broadcast by the size of
    their files; the rows to be joined are about as few as they are.
    """
    given = stage(overrides.select(
        "flow", "row_no", F.col("purpose").alias("_purpose"), F.col("amount").alias("_amount")
    ), "overrides")
    # As doubles, equal numbers of different types have one digest.
    digest = F.xxhash64("flow", F.col("row_no").cast("double"))
    marked = with_bit(df, digest, digest_bits(given.select(digest.alias("_digest"))), "_corrected")
    corrected = marked.filter("_corrected").join(given.hint("merge"), ["flow", "row_no"], "left").withColumns({
        "final_purpose": F.coalesce("_purpose", "final_purpose"),
        "amount": F.coalesce("_amount", "amount"),
    }).drop("_purpose", "_amount", "_corrected")
    return corrected.unionByName(marked.filter("not _corrected").drop("_corrected"))


def classify(df: DataFrame, rules: Rules, overrides: DataFrame | None = None) -> DataFrame:
    """``final_purpose``, ``m2_rule`` and ``use_rule`` by all declared rules; manual corrections of the purpose come before the flags."""
    df = purpose_transform(df, rules.purpose)
    if overrides is not None:
        df = apply_overrides(df, overrides)
    return use_flag(m2_flag(df, force_yes=rules.m2_yes, set_no=rules.m2_no), rules.use)


def bank_own(name: Column, patterns: Sequence[str], line_own: Column | None = None) -> Column:
    """Own-account business of a commercial bank, by name pattern or by report line."""
    pattern = "|".join(re.escape(p.upper()) for p in patterns)
    by_name = F.coalesce(F.upper(name).rlike(pattern), F.lit(False))
    return by_name if line_own is None else by_name | F.coalesce(line_own, F.lit(False))
