"""Scalar functions of names and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_BLANK = " \t\n\r\x0b\x0c"


def strip_generics(raw: Column) -> Column:
    """Promises unwrapped as long as one is the whole type, then cut before the first type argument; arrays keep their brackets."""
    text = F.btrim(raw, F.lit(_BLANK))
    wrapped = F.length(F.regexp_extract(text, r"^(?:Promise<\s*)+", 0))

    def peeled(x: Column, _: Column) -> Column:
        whole = x.startswith("Promise<") & x.endswith(">")
        return F.when(whole, F.btrim(F.substring(x, F.lit(9), F.length(x) - 9), F.lit(_BLANK))).otherwise(x)

    inner = F.when(wrapped > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(wrapped, F.lit(1))), text, peeled)).otherwise(text)
    return F.btrim(F.substring_index(inner, "<", 1), F.lit(_BLANK))


def clean_path(path: str) -> str:
    """'.' and '..' resolved, without looking at any file."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if out and out[-1] != "..":
                out.pop()
            elif not path.startswith("/"):
                out.append(part)
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)
