"""Tokens of more kinds: addresses, numbers with a form of their own, dates and times, as one pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import text as T

#: Kinds and their patterns, tried in this order at each place before the plain tokens. The patterns use neither
#: look-around nor word boundaries, so that Java and RE2 read them alike.
PATTERNS = {
    "URL": r"[a-z]+://[^ \t\n\r<>\"]+",
    "EMAIL": r"[\p{L}0-9][\p{L}0-9._%+-]*@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    "DOMAIN": r"www(?:\.[\p{L}0-9-]+)+",
    "HASHTAG": r"#\p{L}[\p{L}0-9_]*",
    "USERNAME": r"@[A-Za-z][A-Za-z0-9_]*",
    "SSN": r"[0-9]{6}-[0-9]{4}",
    "DATEABS": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})",
    "DATEREL": r"[0-9]{1,2}/[0-9]{1,2}",
    "TELNO": r"[0-9]{3}-[0-9]{4}",
    "TIME": r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?",
    "PERCENT": r"[0-9](?:[0-9.,]*[0-9])?%",
    "AMOUNT": r"[$€£][0-9](?:[0-9.,]*[0-9])?",
    "MEASUREMENT": r"[0-9](?:[0-9.,]*[0-9])?(?:km|cm|mm|kg|mg|ml|°C|°F)",
    "ORDINAL": r"[0-9]+(?:st|nd|rd|th)",
    "NUMWLETTER": r"[0-9]+[A-Za-z]",
    "SERIALNUMBER": r"[0-9]+\p{L}[\p{L}0-9]*",
}
#: A letter or digit more makes a number with letters a serial number, so that one is tried before the shorter ones.
LONGEST_FIRST = ("SERIALNUMBER", "MEASUREMENT", "ORDINAL", "NUMWLETTER")
TOKEN = "(" + "|".join([p for k, p in PATTERNS.items() if k not in LONGEST_FIRST] + [PATTERNS[k] for k in LONGEST_FIRST]) + "|" + T.TOKEN[1:]


def kind(token: Column) -> Column:
    """The first kind whose pattern is the whole token, else the plain kind."""
    out = F
    for name, pattern in PATTERNS.items():
        out = out.when(token.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise(T.kind(token))


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """As text.tokens(), with the kinds above."""
    return T.tokens(docs, doc, text, TOKEN, kind)
