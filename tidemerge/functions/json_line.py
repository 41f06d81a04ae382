"""JSON string escapes and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two-character escapes of a log line; other characters below 0x20 are written \\u00xx in lower case.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
BLANKS = " \t\r\n"


def escaped(text: Column) -> Column:
    """``text`` as it stands between the quotes of a JSON string."""
    for plain, short in SHORT_ESCAPES.items():  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(short))
    long = [chr(code) for code in range(32) if chr(code) not in SHORT_ESCAPES]
    has_long = text.rlike("[\\x00-\\x1f]")
    full = text
    for char in long:
        full = F.replace(full, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return F.when(has_long, full).otherwise(text)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), escaped(text), F.lit('"'))


def trimmed(text: Column) -> Column:
    """Without blanks, tabs and line ends at either side."""
    return F.btrim(text, F.lit(BLANKS))
