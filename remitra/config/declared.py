"""Declared rules as data: validated when read, so that a slip of the pen is an error and not a rule that never fires."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from remitra.config import rules as R
from remitra.config import values

# Names of duplicate keys in rule files, and the columns they stand for.
KEY_COLUMNS = {
    "bank": "bank", "flow": "flow", "reference": "ref", "date": "ymd", "amount": "amt_orig", "currency": "currency", "country": "country",
    "purpose": "pur5", "transferorName": "tr_name", "recipientName": "rc_name",
}

_LISTS = {"purposePrefix", "purposeEquals", "sectorPrefix", "nameContains", "remarkContains"}
#: Conditions of a rule; all that are given must hold.
CONDITIONS = {"bank", "flow", "country", "anyOf", *_LISTS}
_FLOWS = ("both", "Payment", "Receive")


class RuleError(ValueError):
    """What is wrong, and where."""

    def __init__(self, where: str, what: str):
        super().__init__(f"{where}: {what}")


@dataclass(frozen=True)
class Rules:
    """All declared rules, in order where order counts."""

    purpose: Sequence[dict] = field(default_factory=lambda: R.PURPOSE_RULES)
    m2_yes: Sequence[dict] = field(default_factory=lambda: R.M2_FORCE_YES)
    m2_no: Sequence[dict] = field(default_factory=lambda: R.M2_SET_NO)
    use: Sequence[dict] = field(default_factory=lambda: R.USE_RULES)
    tiers: Mapping[str, dict] = field(default_factory=lambda: R.DUPLICATE_TIERS)
    rate_bands: Sequence[tuple[str, float, float]] = field(default_factory=lambda: values.RATE_BANDS)
    usd_band: tuple[float, float] = (values.FX_MIN, values.FX_MAX)


def _known(where: str, given: Mapping, allowed: set[str]) -> None:
    if not isinstance(given, Mapping):
        raise RuleError(where, "an object is wanted")
    unknown = sorted(k for k in given if k not in allowed and not k.startswith("_"))
    if unknown:
        raise RuleError(where, f"unknown {', '.join(unknown)}; known are {', '.join(sorted(allowed))}")


def _texts(where: str, given) -> list[str]:
    if not isinstance(given, list) or not given or not all(isinstance(x, str) and x for x in given):
        raise RuleError(where, "a list of texts is wanted")
    return given


def _conditions(where: str, rule: Mapping) -> dict:
    """The rule's conditions, checked."""
    found = {}
    for name in sorted(CONDITIONS & set(rule)):
        value, at = rule[name], f"{where}.{name}"
        if name in _LISTS:
            found[name] = _texts(at, value)
        elif name == "flow":
            if value not in _FLOWS:
                raise RuleError(at, f"one of {', '.join(_FLOWS)} is wanted")
            found[name] = value
        elif name == "anyOf":
            if not isinstance(value, list) or not value:
                raise RuleError(at, "a list of conditions is wanted")
            options = []
            for k, option in enumerate(value):
                _known(f"{at}[{k}]", option, CONDITIONS)
                options.append(_conditions(f"{at}[{k}]", option))
                if not options[-1]:
                    raise RuleError(f"{at}[{k}]", "no condition")
            found[name] = options
        elif name == "bank" and isinstance(value, list):
            found[name] = _texts(at, value)
        elif isinstance(value, str) and value.strip("!"):
            found[name] = value
        else:
            raise RuleError(at, "a text is wanted")
    return found


def _rules(where: str, given, more: set[str]) -> list[tuple[str, Mapping, dict]]:
    if not isinstance(given, list):
        raise RuleError(where, "a list of rules is wanted")
    rows = []
    for k, rule in enumerate(given):
        at = f"{where}[{k}]"
        _known(at, rule, CONDITIONS | more | {"why"})
        rows.append((at, rule, _conditions(at, rule)))
    return rows


def purpose_rules(given) -> list[dict]:
    out, ids = [], set()
    for at, rule, conditions in _rules("purposeTransform.rules", given, {"id", "action", "to"}):
        if not isinstance(rule.get("id"), str) or rule["id"] in ids:
            raise RuleError(at, "an id of its own is wanted")
        ids.add(rule["id"])
        if rule.get("action") not in ("keep", "set"):
            raise RuleError(at, "action is keep or set")
        if (rule["action"] == "set") != isinstance(rule.get("to"), str):
            raise RuleError(at, "set needs a code in to, keep has none")
        out.append({"id": rule["id"], **conditions, "action": rule["action"], **({"to": rule["to"]} if "to" in rule else {})})
    return out


def flag_rules(where: str, given) -> list[dict]:
    out = []
    for at, _, conditions in _rules(where, given, set()):
        if not conditions:
            raise RuleError(at, "no condition")
        out.append(conditions)
    return out


def use_rules(given) -> list[dict]:
    out = []
    for at, rule, conditions in _rules("useFlag.rules", given, {"value", "default"}):
        if out and out[-1].get("default"):
            raise RuleError(at, "no rule can follow the default")
        if not isinstance(rule.get("value"), str) or not rule["value"]:
            raise RuleError(at, "a value is wanted")
        if bool(conditions) == (rule.get("default") is True):
            raise RuleError(at, "either conditions or default are wanted")
        out.append({"value": rule["value"], **conditions, **({"default": True} if not conditions else {})})
    if not out or not out[-1].get("default"):
        raise RuleError("useFlag.rules", "the last rule must be the default")
    return out


def duplicate_tiers(given) -> dict[str, dict]:
    """Keys as columns; the year is always one of them."""
    _known("duplicates", given, {k for k in given if k.startswith("tier")} if isinstance(given, Mapping) else set())
    out = {}
    for name in sorted(k for k in given if not k.startswith("_")):
        tier, at = given[name], f"duplicates.{name}"
        _known(at, tier, {"keys", "minReferenceLength", "requireNames", "why"})
        keys = _texts(f"{at}.keys", tier.get("keys"))
        unknown = [k for k in keys if k not in KEY_COLUMNS]
        if unknown:
            raise RuleError(f"{at}.keys", f"unknown {', '.join(unknown)}; known are {', '.join(KEY_COLUMNS)}")
        found: dict = {"keys": [*(KEY_COLUMNS[k] for k in keys), "yr"]}
        least = tier.get("minReferenceLength")
        if least is not None:
            if not isinstance(least, int) or isinstance(least, bool) or least < 1:
                raise RuleError(f"{at}.minReferenceLength", "a positive whole number is wanted")
            found["min_reference"] = least
        if "requireNames" in tier:
            if not isinstance(tier["requireNames"], bool):
                raise RuleError(f"{at}.requireNames", "true or false is wanted")
            found["names"] = "present" if tier["requireNames"] else "absent"
        out[name.removeprefix("tier")] = found
    return out


def _band(where: str, given) -> tuple[float, float]:
    _known(where, given, {"min", "max", "note"})
    low, high = given.get("min"), given.get("max")
    if not all(isinstance(x, int | float) and not isinstance(x, bool) for x in (low, high)) or not low <= high:
        raise RuleError(where, "numbers min and max are wanted, in this order")
    return float(low), float(high)


def parse(document: Mapping) -> Rules:
    """Rules of a file; a section that it leaves out keeps the built-in ones."""
    _known("rules", document, {"purposeTransform", "m2Flag", "useFlag", "exchangeRate", "duplicates", "manualOverrides"})
    found: dict = {}
    if "purposeTransform" in document:
        _known("purposeTransform", document["purposeTransform"], {"rules"})
        found["purpose"] = purpose_rules(document["purposeTransform"].get("rules"))
    if "m2Flag" in document:
        _known("m2Flag", document["m2Flag"], {"forceYes", "setNo"})
        found["m2_yes"] = flag_rules("m2Flag.forceYes", document["m2Flag"].get("forceYes", []))
        found["m2_no"] = flag_rules("m2Flag.setNo", document["m2Flag"].get("setNo", []))
    if "useFlag" in document:
        _known("useFlag", document["useFlag"], {"rules"})
        found["use"] = use_rules(document["useFlag"].get("rules"))
    if "duplicates" in document:
        found["tiers"] = duplicate_tiers(document["duplicates"])
    rates = document.get("exchangeRate")
    if rates is not None:
        _known("exchangeRate", rates, {"bands", "usdPerUsdBand", "manualOverrideSheet", "manualOverrideNote"})
        if "bands" in rates:
            _known("exchangeRate.bands", rates["bands"], set(rates["bands"]))
            found["rate_bands"] = [(c.strip().upper(), *_band(f"exchangeRate.bands.{c}", b)) for c, b in rates["bands"].items()]
        if "usdPerUsdBand" in rates:
            found["usd_band"] = _band("exchangeRate.usdPerUsdBand", rates["usdPerUsdBand"])
    return Rules(**found)


def in_force(rules: Rules) -> list[tuple[str, int, str, str]]:
    """(section, position, name, declaration as JSON) of every rule, for readers of the published tables."""
    import json

    text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    sections = {
        "purpose": [(r["id"], r) for r in rules.purpose], "m2_yes": [("Yes", r) for r in rules.m2_yes], "m2_no": [("No", r) for r in rules.m2_no],
        "use": [(r["value"], r) for r in rules.use], "duplicates": list(rules.tiers.items()),
        "rate_band": [(c, {"min": low, "max": high}) for c, low, high in rules.rate_bands],
        "usd_band": [("LAK per USD", {"min": rules.usd_band[0], "max": rules.usd_band[1]})],
    }
    return [(section, k, name, text(rule)) for section, rows in sections.items() for k, (name, rule) in enumerate(rows)]
