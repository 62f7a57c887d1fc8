"""JSON texts in one form: keys in order, no blanks, numbers as their shortest double, and no character that HTML gives a meaning to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between the numbers of a compact JSON text (strings, words and marks), or a number. Possessive, so that a long string needs no deep stack.
_TOKEN = r'(?:"(?:[^"\\]++|\\.)*+"|[a-z]++|[{}\[\]:,]++)++|-?[0-9][0-9.eE+-]*+'
#: Integers that a double holds and whose shortest digits are their own.
_PLAIN = r"^-?[1-9][0-9]{0,14}(\.0+)?$"

#: Characters that never stand in a line as they are, all of which can only be inside strings.
_HTML = ("<", ">", "&", chr(0x2028), chr(0x2029))


def html_safe(text: Column) -> Column:
    """A JSON text without characters that HTML gives a meaning to."""
    for plain in _HTML:
        text = F.replace(text, F.lit(plain), F.lit(chr(92) + f"u{ord(plain):04x}"))
    return text


def number_text(number: Column) -> Column:
    """A JSON number as its double's shortest digits: plain from 1e-6 to below 1e21, else with an exponent; an integer has no point."""
    value = number.cast("double")
    short, size = value.cast("string"), F.abs(value)
    trim = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    small, large = short.try_cast("decimal(38,30)").cast("string"), short.try_cast("decimal(38,16)").cast("string")
    exponent = F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), "E", "e")
    signed = F.when(F.contains(exponent, F.lit("e-")), exponent).otherwise(F.replace(exponent, F.lit("e"), F.lit("e+")))
    return F.when(value == 0, "0").when((size >= 1e-6) & (size < 1), trim(small)).when((size >= 1) & (size < 1e21), trim(large)).otherwise(signed)


def compact_json(text: Column) -> Column:
    """``canonical_json`` with the characters of HTML as they are, for a text that is made safe as a whole."""
    compact = F.to_json(F.try_parse_json(text))
    tokens = F.regexp_extract_all(compact, F.lit(_TOKEN), F.lit(0))
    # By its first character: no mark, quote or letter is in this range.
    number = lambda t: (t >= "-") & (t < ":")
    form = lambda t: F.when(t.rlike(_PLAIN), F.substring_index(t, ".", 1)).otherwise(number_text(t))
    return F.array_join(F.transform(tokens, lambda t: F.when(number(t), form(t)).otherwise(t)), "")


def canonical_json(text: Column) -> Column:
    """The one form of a JSON text; null if it can't be read. Keys are in byte order at every depth, an object that names one twice can't be read."""
    return html_safe(compact_json(text))
