"""Scalar functions of the archive engine: labels, links, MIME types, charsets, URLs, highlighting."""

from __future__ import annotations

import mimetypes
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_EXTENSIONS = (".txt", ".htm", ".html", ".xml", ".xhtml")
_EXTENSION = r"(\.[^.]*)$"

_types = mimetypes.MimeTypes()
MIME = {e: _types.guess_type("x" + e)[0] for e in (".htm", ".html", ".css", ".txt", ".json", ".gif", ".jpg", ".jpeg", ".jpe", ".png")}
MIME |= {".hhc": "text/text", ".hhk": "text/text", ".js": "application/javascript", ".bmp": "image/bitmap", ".ico": "image/x-icon"}
DEFAULT_MIME = "application/octet-stream"


def extension(path: Column) -> Column:
    """From the last dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(path, _EXTENSION, 1))


def is_text_file(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in sorted(MIME.items()) for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(DEFAULT_MIME))


def fix_link(path: Column) -> Column:
    """Keeps links to objects apart from the server's own pages."""
    return F.when(path == "/", "/nonchmweb/").when(path.startswith("/chmweb/"), F.concat(F.lit("/nonchmweb/"), F.substring(path, 9, 1 << 20))).otherwise(path)


def fix_encoding(encoding: Column) -> Column:
    return F.when((encoding == "Latin1") | encoding.startswith("CP"), "UTF8").otherwise(encoding)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[.][^.]+$", ""), r".*[\\/]|\.[^.]*$", "")


def decode_url_path(s: Column) -> Column:
    """Percent-decoding; a plus sign stays."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def decode_url_query(s: Column) -> Column:
    """Percent-decoding; a plus sign is a space."""
    return F.try_url_decode(s)


def query_parameters(query: Column) -> Column:
    """Map of name to value; pairs that don't split on = into two non-empty parts are dropped, the last of a name wins."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.split(p, "="))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[1] != ""))
    entries = F.transform(good, lambda p: F.struct(decode_url_query(p[0]).alias("key"), decode_url_query(p[1]).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def highlight_terms(query: str) -> list[str]:
    """Quoted phrases as they are, other text split at spaces, signs and the words AND and OR."""
    out: list[str] = []
    for i, part in enumerate(unquote(query).strip().replace("+", " ").split('"')):
        part = part.strip()
        terms = [part] if i % 2 else re.split(r"\s+", re.sub(r"[+,()]|%(?:29|28)|\W+(?:AND|OR)\W+", " ", part))
        out += [t for t in terms if t]
    return out


def highlight(text: Column, query: str) -> Column:
    """Marks the first hit of each term (ignoring case) outside of marks."""
    terms = highlight_terms(query)
    if not terms:
        return text
    pattern = "(?i)(" + "|".join(r"\Q" + t.replace(r"\E", "") + r"\E" for t in terms) + ")"
    return F.regexp_replace(text, pattern, '<span class="searchword">$1</span>')
