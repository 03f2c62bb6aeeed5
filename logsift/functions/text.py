"""String columns with the semantics of Python text handling.

Everything here is a built-in Column expression, so it stays inside
whole-stage code generation and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a line is stripped.
STRIPPED_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line separators that Spark's text source leaves inside a line.
EXTRA_LINE_BREAKS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# Word characters are letters, numbers of any kind and the underscore. They are
# spelt out because Java's Unicode \b also counts combining marks. The digit is
# matched before the look-behind, so most positions fail on the first test.
_WORD = "[\\w\\p{L}\\p{N}]"
_FIRST_DIGIT = f"\\p{{Nd}}(?<!{_WORD}\\p{{Nd}})"
_NOT_BEFORE_WORD = f"(?!{_WORD})"
_OCTET = "\\p{Nd}{1,3}+"

_IP = f"{_FIRST_DIGIT}\\p{{Nd}}{{0,2}}+\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}{_NOT_BEFORE_WORD}"
_UUID = f"(?<!{_WORD})[a-fA-F0-9]{{8}}(?:-[a-fA-F0-9]{{4}}){{3}}-[a-fA-F0-9]{{12}}{_NOT_BEFORE_WORD}"
_NUMBER = f"{_FIRST_DIGIT}\\p{{Nd}}*+{_NOT_BEFORE_WORD}"


def strip(text: Column) -> Column:
    """Cut white space of every kind from both ends."""
    return F.btrim(text, F.lit(STRIPPED_CHARS))


def chomp(text: Column) -> Column:
    """Cut line ends: line feeds first, then carriage returns."""
    return F.rtrim(F.rtrim(text, F.lit("\n")), F.lit("\r"))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def drop_undecodable(text: Column) -> Column:
    """Remove the replacement characters the text source put in for bad bytes."""
    return F.translate(text, "\ufffd", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mask_ips(text: Column) -> Column:
    return F.regexp_replace(text, _IP, "<IP>")


def mask_uuids(text: Column) -> Column:
    return F.regexp_replace(text, _UUID, "<UUID>")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, _NUMBER, "<NUM>")


def log_template(text: Column) -> Column:
    """Addresses, then identifiers, then remaining whole-word numbers become tokens."""
    return mask_numbers(mask_uuids(mask_ips(text)))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clamp_batch_size(batch_size: int) -> int:
    return max(1, int(batch_size))


def clamp_poll_seconds(seconds: float) -> float:
    return max(0.0, float(seconds))
