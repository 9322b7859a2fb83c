"""String rules used by every stage, as plain column expressions.

White space follows the Unicode notion a Python programmer expects from
``str.strip`` / ``str.split``; Spark's own ``trim`` only knows U+0020 and
Java's ``\\s`` only ASCII, so the character set is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class (with and without line breaks).
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INLINE_WS = r"[\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"

# Every line break other than "\n".
LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# A numbering prefix (1, 1.1, 1.2.3., IV., A. or nothing) and
# the white space behind it, at the start of a label, in any letter case.
LABEL_PREFIX = (
    "^" + WS + "*"
    r"(?:\p{Nd}+(?:\.\p{Nd}+)*\.?"
    r"|[IVXLCivxlc\u0130\u0131]+\.?"
    r"|[A-Za-z\u0130\u0131\u017f\u212a]\."
    "|)" + WS + "+"
)

# Digits that are not decimal digits (superscripts, circled, ...)
# but still count as digits in an amount.
OTHER_DIGITS = (
    r"\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
)


def _amount(digit: str) -> str:
    number = rf"[{digit}][{digit},. ]*+"
    return rf"\A[,. ]*+(?:\([,. ]*+{number}\)|{number})[,. ]*+\z"


# Nearly all amounts are plain; the wide class is slow, so it comes second.
_PLAIN_AMOUNT = _amount("0-9")
_AMOUNT = _amount(r"\p{Nd}" + OTHER_DIGITS)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def has_any(c: Column, characters: str) -> Column:
    """True if one of the characters occurs.  A search per character is much
    cheaper than a regex pass with a character class."""
    found = F.lit(False)
    for ch in characters:
        found = found | c.contains(ch)
    return found


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, WS + "+", " ")


def unify_line_breaks(c: Column) -> Column:
    # only unusual texts need the replacing pass
    unusual = has_any(c, "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
    return F.when(unusual, F.regexp_replace(c, LINE_BREAKS, "\n")).otherwise(c)


def split_lines(c: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    parts = F.split(unify_line_breaks(c), "\n")
    open_end = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, F.lit(1), F.size(parts) - open_end)


def is_value(c: Column) -> Column:
    """True for an amount: digits with ``, .`` and spaces, optionally in ( )."""
    return is_stripped_value(strip(c))


def is_stripped_value(s: Column) -> Column:
    # an amount's only white space is the blank, and without white space there is no prefix
    prefixed = s.contains(" ") & s.rlike(LABEL_PREFIX)
    return (s.rlike(_PLAIN_AMOUNT) | s.rlike(_AMOUNT)) & ~prefixed


def clean_label(c: Column) -> Column:
    """Drop one numbering prefix and surrounding white space."""
    return strip(F.regexp_replace(c, LABEL_PREFIX, ""))


def normalize_keyword(c: Column) -> Column:
    """Lower case, single spaces, plain dashes; NULL becomes empty."""
    base = squeeze(F.lower(strip(F.coalesce(c, F.lit("")))))
    return F.translate(base, "–—", "--")


def table_key(c: Column) -> Column:
    """Form under which a table name is looked up in the canon."""
    return F.lower(strip(c))


def table_compare_form(c: Column) -> Column:
    """Form under which two table names count as equal."""
    return squeeze(strip(F.upper(F.coalesce(c, F.lit("")))))


def numeric_value(c: Column, thousands: str = ".", decimal: str = ",") -> Column:
    """Typed amount of an accounting string; parentheses mean negative."""
    s = strip(c)
    negative = s.startswith("(") & s.endswith(")")
    plain = F.translate(F.translate(s, f"() {thousands}", ""), decimal, ".")
    number = plain.try_cast("decimal(38,6)")
    return F.when(negative, -number).otherwise(number)


def json_string(c: Column) -> Column:
    """The JSON literal of one string."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


# JSON as the standard has it.
STRICT_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def single_object(json: Column, element: str) -> Column:
    """Parse one JSON object; NULL if it is malformed or followed by more."""
    # inside [ ] anything behind the object makes the array malformed or longer
    wrapped = F.from_json(
        F.concat(F.lit("["), json, F.lit("]")), f"array<{element}>", STRICT_JSON
    )
    return F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0)))
