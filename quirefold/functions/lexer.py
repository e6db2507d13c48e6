"""HTML lexer and tokeniser as native expressions.

Markup is cut into tags, entities and text; tags part words, entities are decoded in place, and words are runs of
ASCII word characters (lower-cased) or single letters and digits beyond ASCII (as they are). Stop words go before
positions are counted. Supplementary characters part words.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import name2codepoint

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Possessive quantifiers keep the matcher from deep recursion on long runs.
_LEXEMES = r"""<(?:[^"'>]++|"[^"]*+"|'[^']*+')*+(?:>|"[^"]*+\z|'[^']*+\z|\z)|&#?[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]*+[;<]?|[^<&]++"""
WORD_CHARS = "$_'"
MAX_WORD = 16

ENTITIES = {name: chr(c) for name, c in name2codepoint.items() if c in (34, 38, 60, 62) or 160 <= c <= 255}


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


def word_pattern(word_chars: str = WORD_CHARS) -> str:
    return rf"[A-Za-z0-9{_class(word_chars)}]+|[\p{{L}}\p{{Nd}}&&[\x{{80}}-\x{{FFFF}}]]"


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entity(e: Column) -> Column:
    """What an entity from & to ; stands for; itself if unknown or of less than 2 or more than 6 characters."""
    body = F.substring(e, 2, F.length(e) - 2)
    named = F.create_map(*(F.lit(x) for kv in sorted(ENTITIES.items()) for x in kv))
    value = (
        F.when(body.rlike("^#[0-9]+$"), _code_point(F.substring(body, 2, F.length(body)).cast("bigint")))
        .when(body.rlike("^#[xX][0-9A-Fa-f]+$"), _code_point(F.conv(F.substring(body, 3, F.length(body)), 16, 10).cast("bigint")))
        .otherwise(F.try_element_at(named, body))
    )
    return F.when(F.length(body).between(2, 6), F.coalesce(value, e)).otherwise(e)


def _lexeme(e: Column) -> Column:
    entity = F.when(e.endswith(";"), decode_entity(e)).when(e.endswith("<"), F.substring(e, 1, F.length(e) - 1)).when(e == "&", e).otherwise("")
    return F.when(e.startswith("<"), " ").when(e.startswith("&"), entity).otherwise(e)


def plain_text(html: Column) -> Column:
    """Text with markup removed and entities decoded, as the tokeniser sees it."""
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_LEXEMES), F.lit(0)), _lexeme), "")


def split_words(text: Column, stop_words: Iterable[str] = (), word_chars: str = WORD_CHARS) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(word_pattern(word_chars)), F.lit(0)), lambda w: F.when(w < "\x7f", F.lower(w)).otherwise(w))
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def words(html: Column, stop_words: Iterable[str] = (), word_chars: str = WORD_CHARS) -> Column:
    """Array of the words of a marked-up text; position is the place in it."""
    return split_words(plain_text(html), stop_words, word_chars)


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """The lines of a file of stop words; such a list is short."""
    return [r[0] for r in spark.read.text(path).filter(F.trim("value") != "").distinct().collect()]


# The same in DuckDB's dialect, for checking.

_SQL_LEXEMES = _LEXEMES.replace("++", "+").replace("*+", "*").replace(r"[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]", r"[\p{L}\p{Nd}]")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_plain_text(html: str) -> str:
    named = "MAP {" + ", ".join(f"{_quote(k)}: {_quote(v)}" for k, v in sorted(ENTITIES.items())) + "}"
    body = "substr(e, 2, length(e) - 2)"
    return f"""array_to_string(list_transform(regexp_extract_all(regexp_replace(coalesce({html}, ''), '[\\x{{10000}}-\\x{{10FFFF}}]', chr(1), 'g'), {_quote(_SQL_LEXEMES)}), lambda e:
      CASE WHEN e[1] = '<' THEN ' ' WHEN e[1] <> '&' THEN e
           WHEN e[-1] = ';' THEN CASE WHEN length({body}) NOT BETWEEN 2 AND 6 THEN e
                WHEN regexp_full_match({body}, '#[0-9]+') THEN chr(substr(e, 3, length(e) - 3)::INT)
                WHEN regexp_full_match({body}, '#[xX][0-9A-Fa-f]+') THEN chr(('0x' || substr(e, 4, length(e) - 4))::INT)
                ELSE coalesce({named}[{body}], e) END
           WHEN e[-1] = '<' THEN substr(e, 1, length(e) - 1) WHEN e = '&' THEN e ELSE '' END), '')"""


def sql_words(html: str, stop_words: Iterable[str] = (), marked_up: bool = True) -> str:
    text = sql_plain_text(html) if marked_up else f"coalesce({html}, '')"
    w = _quote(r"[A-Za-z0-9$_']+|[^\x00-\x7F$_'\P{L}]|[^\x00-\x7F\P{Nd}]")
    out = f"list_transform(regexp_extract_all({text}, {w}), lambda w: CASE WHEN ord(w) < 128 THEN lower(w) ELSE w END)"
    stop = sorted(set(stop_words))
    return f"list_filter({out}, lambda w: w NOT IN ({', '.join(map(_quote, stop))}))" if stop else out
