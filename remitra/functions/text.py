"""Text rules as JVM-side column expressions; only NFC leaves the JVM, in Arrow batches.

The column form of NFC is for capped lists and aggregates. Rows that wait for
Python's answers are queued, and once memory is short all that follow are
written to disk uncompressed; long tables take ``operators.names.with_clean_names``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The space separators, and all characters that count as white space.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BLANKS = SPACES + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"

# Letters that betray text decoded with the wrong code page, letters that
# show a repair went wrong, and what surrounds a name without belonging to it.
SUSPECT = "[ÃÂàáâãäåæçèéêëìíîï]"
STILL_WRONG = "[Ãàº»]"
NAME_EDGE = " .,-_/\\\"'"
# The code page 1252 characters of bytes 80-9F that are defined, and those bytes.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def zs_trim(c: Column) -> Column:
    """Strip every Unicode space separator; ``trim`` would strip U+0020 only."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(zs_trim(c), F.lit(""))


def upper_code(c: Column) -> Column:
    return F.upper(blank_to_null(c))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def norm_header(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def clean_text(c: Column, apostrophe: bool = True) -> Column:
    """Strip; drop the one apostrophe that forces a cell to text; blank becomes NULL."""
    s = strip(c)
    if apostrophe:
        s = F.when(s.startswith("'"), strip(F.substring(s, 2, 2**31 - 1))).otherwise(s)
    return F.nullif(s, F.lit(""))


def fix_mojibake(c: Column) -> Column:
    """Repair UTF-8 that was read as code page 1252; keep the input if that cannot be done."""
    single = F.translate(c, CP1252, CP1252_BYTES)
    # Only one-byte characters may reach encode(), which refuses all others.
    single = F.when(c.rlike(SUSPECT) & ~single.rlike(r"[^\x00-\x{FF}]"), single)
    repaired = F.try_validate_utf8(F.encode(single, "ISO-8859-1").cast("string"))
    return F.when(repaired.isNotNull() & ~repaired.rlike(STILL_WRONG), repaired).otherwise(c)


def nfc(c: Column) -> Column:
    """Unicode normal form C, a batch at a time.

    Text below U+0300 is in that form already and is not sent to Python at all.
    """
    # A local function travels by value, so tasks need not import this package.
    def normalize(values: pa.Array) -> pa.Array:
        import unicodedata

        composed = [v and unicodedata.normalize("NFC", v) for v in values.to_pylist()]
        return pa.array(composed, type=pa.string())

    affected = F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)
    return F.coalesce(F.arrow_udf(normalize, T.StringType())(affected), c)


def norm_text(c: Column) -> Column:
    """NFC, whitespace collapsed, blank to NULL. Apply to grouped names: NFC runs in Python."""
    return F.nullif(collapse(nfc(c)), F.lit(""))


def without_edge(c: Column) -> Column:
    """What a name in NFC is cleaned of: runs of white space, and what surrounds it; blank to NULL."""
    return F.nullif(F.btrim(collapse(c), F.lit(NAME_EDGE)), F.lit(""))


def clean_name(c: Column) -> Column:
    return without_edge(nfc(fix_mojibake(c)))


def bank_key(c: Column) -> Column:
    """What is left of a bank's spelling to compare: upper-case letters and digits."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def named(c: Column) -> Column:
    """A counterparty name: three characters, not only digits, with a Latin or Lao letter."""
    s = zs_trim(c)
    return (
        (F.length(s) >= 3)
        & ~s.rlike("^[0-9]+$")
        & s.rlike(r"[A-Za-z\x{0E80}-\x{0EFF}]")
    )


def real_name(raw: Column, cleaned: Column, block: Sequence[str]) -> Column:
    """The stricter test for printed names, which both the filed and the cleaned form must pass."""
    tests = []
    for form in (raw, cleaned):
        s = F.coalesce(strip(form), F.lit(""))
        tests.append((F.length(s) >= 3) & ~F.upper(s).isin(*block) & s.rlike(r"\p{L}"))
    return tests[0] & tests[1]


def is_missing(c: Column) -> Column:
    # From the left alone: that ends at the first character which is no space.
    return c.isNull() | (F.ltrim(c.cast("string"), F.lit(SPACES)) == "")


def title_case(c: Column, acronyms: Sequence[str]) -> Column:
    keep = F.array(*[F.lit(a.upper()) for a in acronyms])
    word = lambda w: F.when(F.array_contains(keep, F.upper(w)), w).otherwise(F.initcap(w))
    return F.array_join(F.transform(F.split(c, " "), word), " ")


def head_token(c: Column) -> Column:
    """The part before the first colon, which names a transfer method."""
    return F.lower(strip(F.split(c, ":")[0]))
