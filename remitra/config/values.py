"""Lookup values. Every table here is fixed and small: its size never grows with the data."""

from __future__ import annotations

# Two-digit purpose groups as (code, English, Lao, account).
PUR2 = [
    ("01", "Goods", "ສິນຄ້າ", "current"),
    ("02", "Services", "ບໍລິການ", "current"),
    ("03", "Primary income", "ລາຍໄດ້ຂັ້ນໜຶ່ງ", "current"),
    ("04", "Secondary income", "ລາຍໄດ້ຂັ້ນສອງ", "current"),
    ("05", "Financial account", "ບັນຊີການເງິນ", "financial"),
    ("06", "Unclassifiable", "ບໍ່ສາມາດຈັດປະເພດ", "other"),
    ("07", "Goods, no cross-border movement", "ສິນຄ້າບໍ່ມີການສົ່ງອອກ", "current"),
    ("99", "Unclassified", "ບໍ່ໄດ້ຈັດປະເພດ", "other"),
]
PUR2_OTHER = "99"

# Plausible kip per US dollar, days after which a report is late,
# factors by which a rate may differ from its yearly median, observations a median needs.
FX_MIN, FX_MAX = 7000.0, 25000.0
LATE_DAYS = 30
WRONG_RATE_FACTOR = 3
BAND_FACTOR = 2
MEDIAN_MIN_ROWS = 30

# How much each capped report carries.
ENTITY_LIMIT = 4000
ENTITY_TX_LIMIT = 12
ENTITY_TOP = 5
EXCEPTION_LIMIT = 300
DAILY_CURRENCIES = 10
ENTITY_DAY_MIN = 500_000.0
MIN_REFERENCE_LENGTH = 4

# Amount bands as (from, to, label).
SIZE_BANDS = [
    (0, 1_000, "< $1k"),
    (1_000, 10_000, "$1k-$10k"),
    (10_000, 100_000, "$10k-$100k"),
    (100_000, 1_000_000, "$100k-$1m"),
    (1_000_000, 10_000_000, "$1m-$10m"),
    (10_000_000, None, "> $10m"),
]

# Fields whose completeness is reported, as (column, English, Lao).
QUALITY_FIELDS = [
    ("sub_date", "Submission date", "ວັນທີສົ່ງ"),
    ("country", "Counterpart country", "ປະເທດຄູ່ຮ່ວມ"),
    ("currency", "Currency", "ສະກຸນເງິນ"),
    ("usd", "Amount (USD)", "ມູນຄ່າ (USD)"),
    ("method_raw", "Transfer method", "ວິທີໂອນ"),
    ("lsic", "LSIC industry code", "ລະຫັດ LSIC"),
    ("tr_name", "Transferor name", "ຊື່ຜູ້ໂອນ"),
    ("rc_name", "Recipient name", "ຊື່ຜູ້ຮັບ"),
    ("tr_tin", "Transferor TIN", "ເລກ TIN ຜູ້ໂອນ"),
    ("rc_tin", "Recipient TIN", "ເລກ TIN ຜູ້ຮັບ"),
    ("docs", "Supporting documents", "ເອກະສານປະກອບ"),
]

# The six goods codes reported apart, with their home direction.
GOODS = [
    ("010107", "in"),
    ("010105", "in"),
    ("010102", "in"),
    ("010109", "out"),
    ("010110", "out"),
    ("010301", "out"),
]

# English country names by code.
COUNTRY_NAMES = {
    "CN": "China", "US": "United States", "HK": "Hong Kong SAR", "TH": "Thailand",
    "SG": "Singapore", "MO": "Macao SAR", "VN": "Viet Nam", "RU": "Russia",
    "GB": "United Kingdom", "AU": "Australia", "KR": "Korea, Rep.", "JP": "Japan",
    "AE": "United Arab Emirates", "MY": "Malaysia", "DE": "Germany", "FR": "France",
    "IN": "India", "ID": "Indonesia", "TW": "Taiwan", "CH": "Switzerland",
    "NL": "Netherlands", "IT": "Italy", "CA": "Canada", "BE": "Belgium",
    "KH": "Cambodia", "MM": "Myanmar", "PH": "Philippines", "NZ": "New Zealand",
    "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "FI": "Finland",
    "ES": "Spain", "AT": "Austria", "PL": "Poland", "TR": "Turkiye",
    "SA": "Saudi Arabia", "QA": "Qatar", "KW": "Kuwait", "IL": "Israel",
    "ZA": "South Africa", "BR": "Brazil", "MX": "Mexico", "AR": "Argentina",
    "CL": "Chile", "LU": "Luxembourg", "IE": "Ireland", "PT": "Portugal",
    "GR": "Greece", "CZ": "Czechia", "HU": "Hungary", "RO": "Romania",
    "UA": "Ukraine", "KZ": "Kazakhstan", "BD": "Bangladesh", "PK": "Pakistan",
    "LK": "Sri Lanka", "NP": "Nepal", "MN": "Mongolia", "BN": "Brunei",
    "LA": "Lao PDR", "VG": "British Virgin Islands", "KY": "Cayman Islands",
    "BM": "Bermuda", "PA": "Panama", "CY": "Cyprus", "MT": "Malta",
    "MU": "Mauritius", "SC": "Seychelles", "WS": "Samoa", "LI": "Liechtenstein",
    "MC": "Monaco", "AD": "Andorra", "IM": "Isle of Man", "JE": "Jersey",
    "GG": "Guernsey", "BS": "Bahamas", "BB": "Barbados", "CR": "Costa Rica",
    "EG": "Egypt", "NG": "Nigeria", "KE": "Kenya", "MA": "Morocco",
    "BH": "Bahrain", "OM": "Oman", "JO": "Jordan", "LB": "Lebanon",
    "IQ": "Iraq", "IR": "Iran", "AF": "Afghanistan", "UZ": "Uzbekistan",
    "BY": "Belarus", "RS": "Serbia", "HR": "Croatia", "SI": "Slovenia",
    "SK": "Slovakia", "BG": "Bulgaria", "EE": "Estonia", "LV": "Latvia",
    "LT": "Lithuania", "IS": "Iceland", "MV": "Maldives", "FJ": "Fiji",
    "PG": "Papua New Guinea", "TL": "Timor-Leste", "MG": "Madagascar",
}

# What banks type where there is no counterparty to name.
PLACEHOLDER_NAMES = [
    "NULL", "NONE", "N/A", "NA", "NIL", "N.A.", "UNKNOWN", "NOT AVAILABLE",
    "XXX", "XX", "X", "XXXX", "XXXXX", "-", ".", "--", "0",
    "CASH", "SELF", "OTHER", "OTHERS", "TEST", "TT", "IB", "SWIFT", "NAME",
]

# Report lines as (id, order, group, own account, codes, catch-all, Lao, English).
REPORT_LINES = [
    ("goods", 1, "current", False, ["01", "07"], False, "ຄ່າສິນຄ້າ", "Goods"),
    ("services", 2, "current", False, ["02"], False, "ຄ່າການບໍລິການ", "Services"),
    ("income", 3, "current", False, ["03", "04"], False,
     "ຄ່າດອກເບ້ຍ ແລະ ເງິນໂອນ", "Interest and transfers"),
    ("dia_out", 4, "financial", False, ["050101"], False,
     "ການລົງທຶນໂດຍກົງຢູ່ຕ່າງປະເທດ", "Lao direct investment abroad"),
    ("fdi", 5, "financial", False, ["050201"], False,
     "ການລົງທຶນໂດຍກົງຈາກຕ່າງປະເທດ", "Foreign direct investment"),
    ("portfolio", 6, "financial", False, ["050102", "050202"], False,
     "ການລົງທຶນໃນຫຼັກຊັບ", "Portfolio investment"),
    ("derivative", 7, "financial", True, ["050103", "050203"], False,
     "ເງິນລົງທຶນອະນຸພັນທາງການເງິນ", "Financial derivatives"),
    ("deposit", 8, "financial", True, ["050104", "050204", "050209"], False,
     "ເງິນຝາກກັບທະນາຄານ", "Deposits with banks"),
    ("loan", 9, "financial", False, ["050105", "050205"], False, "ເງິນກູ້ຢືມ", "Loans"),
    ("tradecredit", 10, "financial", False, ["050206"], False,
     "ສິນເຊື່ອການຄ້າ ແລະ ເງິນຈ່າຍລ່ວງໜ້າ", "Trade credit and advances"),
    ("other", 11, "financial", False, ["05", "06"], True, "ອື່ນໆ", "Other"),
]

# Parts of a name that mark a commercial bank's own account.
OWN_PATTERNS = [
    "BANK", "BANQUE", "ທະນາຄານ", "ICBC", "BOC ", "BCEL", "LDB", "APB", "JDB", "BFL",
    "LVB", "STB", "PSVB", "ACL", "MJB", "IDB", "KBANK", "SCB", "BBL", "VTB", "ANZ",
    "MARUHAN", "PHONGSAVANH", "SACOM", "INDOCHINA", "LAO CHINA", "LAO VIET",
    "LAO FRANCE", "LAO DEVELOPMENT", "LAO CONSTRUCTION",
]

# Bank spellings that differ by more than case or punctuation.
BANK_ALIASES = {
    "sacombank": "SACOM",
    "ICBC": "ICBCV",
    "AYB": "AYBVT",
    "Ayb vc": "AYBVT",
    "ICB": "ICBCV",
}

# Initialisms that keep their capitals in printed names.
ACRONYMS = ["AIF", "PMS", "TP", "EDL", "RTL", "APK", "AIDE", "EDC", "NBB", "LCB", "OPD"]

# Kip per unit of currency as (currency, lowest, highest).
RATE_BANDS = [
    ("USD", 19000.0, 23000.0),
    ("EUR", 20000.0, 30000.0),
    ("CNY", 2000.0, 4000.0),
    ("THB", 500.0, 900.0),
    ("AUD", 12000.0, 20000.0),
    ("CAD", 13000.0, 20000.0),
    ("GBP", 25000.0, 35000.0),
    ("JPY", 100.0, 300.0),
    ("SGD", 14000.0, 20000.0),
    ("VND", 0.5, 2.0),
    ("LAK", 0.9, 1.1),
]

# A published US dollar rate must lie in this range.
PUBLISHED_USD_MIN, PUBLISHED_USD_MAX = 15000.0, 40000.0
