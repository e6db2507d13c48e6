"""Brute-force search with regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_regex_query(query: str) -> list[str]:
    """Keywords, any of which may match. Spaces part them; quoted text is literal; a backslash stays only before a space or a class letter."""
    out: list[str] = []
    now, quoted, i = "", False, 0
    while i < len(query):
        c = query[i]
        if c == "\\":
            if query[i + 1 : i + 2] in tuple(" wWsSdD"):
                now += query[i : i + 2]
                i += 1
        elif c == '"':
            now += r"\E" if quoted else r"\Q"
            if quoted:
                if len(now) > 4:
                    out.append(now)
                now = ""
            quoted = not quoted
        elif c == " " and not quoted:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return [*out, now] if now else out


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns)) if patterns else F.lit(False)


def regex_search(units: DataFrame, query: str, text: str = "text", limit: int = 0, raw: bool = False) -> DataFrame:
    """Units whose text a keyword matches, in directory order. raw: the query is one pattern as it is."""
    found = units.filter(any_pattern(F.col(text), [query] if raw else split_regex_query(query))).orderBy("ord")
    return found.limit(limit) if limit > 0 else found
