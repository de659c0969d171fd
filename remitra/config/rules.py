"""Declared classification rules. Within a list the first match wins."""

from __future__ import annotations

# Purpose rules, in order.
PURPOSE_RULES = [
    {"id": "icbc_deposit_keep", "bank": ["ICBCV", "ICBC"], "flow": "both",
     "purposePrefix": ["050104", "050204"], "action": "keep"},
    {"id": "nonbcel_05020401_keep", "bank": "!BCEL", "flow": "Receive",
     "purposePrefix": ["05020401"], "action": "keep"},
    {"id": "boc_icbc_050105_keep", "bank": ["BOC", "ICBC"], "flow": "Receive",
     "purposePrefix": ["050105"], "action": "keep"},
    {"id": "boc_icbc_050105_to_02020", "bank": ["BOC", "ICBC"], "flow": "Payment",
     "purposeEquals": ["050105"], "action": "set", "to": "02020"},
    {"id": "050203_to_050103", "bank": "All", "flow": "both",
     "purposePrefix": ["050203"], "action": "set", "to": "050103"},
    {"id": "bcel_kr_to_0301", "bank": "BCEL", "country": "KR", "flow": "both",
     "purposePrefix": ["050104", "050204"], "action": "set", "to": "0301"},
    {"id": "move_fund_keep", "bank": "All", "flow": "both",
     "remarkContains": ["MOVE FUND"], "action": "keep"},
    {"id": "deposit_to_0404", "bank": "All", "flow": "both",
     "purposePrefix": ["050104", "050204"], "action": "set", "to": "0404"},
]

# What forces the money-supply flag to Yes, then what sets it to No.
M2_FORCE_YES = [{"flow": "Payment", "remarkContains": ["CLEARING", "EXCHANGE"]}]
M2_SET_NO = [
    {"purposePrefix": ["050105", "050205", "050204"], "sectorPrefix": ["02", "03"]},
    {"purposePrefix": ["050103", "050104"]},
    {"purposeEquals": ["07"]},
    {"bank": "OPD"},
    {"bank": "BCEL", "nameContains": ["MONEYGRAM"]},
    {"flow": "Receive", "purposePrefix": ["05020301"]},
]

# Labels that say whether, and if not why not, a record is used.
USE_RULES = [
    {"value": "Deposit", "flow": "Receive", "bank": ["ICBCV", "ICBC"],
     "purposePrefix": ["050104", "050204"]},
    {"value": "Re_Deposit", "flow": "Payment", "bank": ["ICBCV", "ICBC"],
     "purposePrefix": ["050104", "050204"]},
    {"value": "FX", "purposeEquals": ["050103", "05010302"]},
    {"value": "Repayment_ICBCV", "remarkContains": ["FORFEITING"]},
    {"value": "Repayment_{bank}", "bank": ["ICBCV", "BOC"], "sectorPrefix": ["02", "03"],
     "remarkContains": ["REPAY", "PRINCIPAL"]},
    {"value": "Loan_{bank}", "bank": ["ICBCV", "BOC"], "sectorPrefix": ["02", "03"],
     "remarkContains": ["LOAN"]},
    {"value": "Yes", "remarkContains": ["CLEARING", "EXCHANGE"]},
    {"value": "No", "anyOf": [
        {"purposePrefix": ["050105", "050205"], "sectorPrefix": ["02", "03"]},
        {"purposePrefix": ["050103", "050104", "050204"]},
        {"purposeEquals": ["07"]},
        {"bank": "BCEL", "nameContains": ["MONEYGRAM"]},
        {"bank": ["ICBCV", "BOC"], "purposePrefix": ["05010504", "05010502", "05020503"]},
        {"purposePrefix": ["05020401"]},
        {"bank": "OPD", "purposePrefix": ["0302010301"]},
        {"bank": "OPD", "purposePrefix": ["010302"]},
    ]},
    {"value": "Yes", "default": True},
]

# What makes two reports copies of each other, in three tiers of confidence.
DUPLICATE_TIERS = {
    "A": {"keys": ["bank", "flow", "ref", "ymd", "amt_orig", "currency", "yr"],
          "min_reference": 4},
    "B": {"keys": ["bank", "flow", "ymd", "amt_orig", "currency", "country", "pur5",
                   "tr_name", "rc_name", "yr"],
          "names": "present"},
    "C": {"keys": ["bank", "flow", "ymd", "amt_orig", "currency", "country", "pur5", "yr"],
          "names": "absent"},
}
