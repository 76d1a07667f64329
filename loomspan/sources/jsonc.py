"""JSON with comments. Outside strings, //, /* */ and # comments, spaces, tabs and line ends are dropped; line ends are dropped in strings
too. Trailing commas stay errors."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'(?P<string>"(?:\\.|[^"\\])*"?)|(?P<drop>//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)|[ \t\r\n]+)', re.S)


def to_json(text: str) -> str:
    return _PART.sub(lambda m: re.sub(r"[\r\n]", "", m["string"]) if m["string"] else "", text)


def loads(text: str) -> Any:
    return json.loads(to_json(text))


def valid(text: str) -> bool:
    try:
        loads(text)
    except ValueError:
        return False
    return True


def translated(text: Column) -> Column:
    """to_json() as a Spark expression: strings are matched first, so that what looks like a comment within them stays."""
    kept = F.regexp_replace(text, r'(?s)("(?:\\.|[^"\\])*+"?)|//[^\n]*+|#[^\n]*+|/\*.*?(?:\*/|\z)|[ \t\r\n]++', "$1")
    return F.regexp_replace(kept, r"[\r\n]", "")
