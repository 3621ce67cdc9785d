"""Text expressions: trimming, number prefixes, escaping, link encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as blank at the ends of a text field.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_as_null(c: Column) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


def text_or(c: Column, default: str) -> Column:
    """``c`` unless it is null or empty (untrimmed), else ``default``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def js_parse_int(c: Column) -> Column:
    """Leading integer of a text, null when there is none or it does not fit."""
    digits = F.regexp_extract(js_trim(c), r"^([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


def ics_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(";"), F.lit("\\;"))
    out = F.replace(out, F.lit(","), F.lit("\\,"))
    out = F.replace(out, F.lit("\r\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def csv_escape(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def form_encode(c: Column) -> Column:
    """Query-string form encoding: blank becomes plus."""
    return F.url_encode(c)


def component_encode(c: Column) -> Column:
    """Percent encoding of one address component; ``!'()*~`` stay readable."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
