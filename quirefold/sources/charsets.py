"""Windows locale ids and the character sets of their archives."""

from __future__ import annotations

import codecs
from locale import windows_locale

# By the primary language (the low ten bits of a locale id), after the ANSI code pages that Windows documents.
_PAGES = {
    "CP1250": ("cs", "hu", "pl", "ro", "hr", "sk", "sq", "sl"),
    "CP1251": ("bg", "ru", "uk", "be", "mk", "tt"),
    "CP1253": ("el",),
    "CP1254": ("tr",),
    "CP1255": ("he",),
    "CP1256": ("ar", "ur", "fa"),
    "CP1257": ("et", "lv", "lt"),
    "CP1258": ("vi",),
    "Shift-JIS": ("ja",),
    "eucKR": ("ko",),
    "TIS-620": ("th",),
    "TSCII": ("ta",),
    "Latin1": ("hy", "ka", "hi", "mr", "sa"),
}
_SPECIAL = {0x043A: "Latin1", 0x0804: "GBK", 0x1004: "GB2313", 0x0404: "Big5", 0x0C04: "Big5", 0x1404: "Big5", 0x081A: "CP1250", 0x0C1A: "CP1251", 0x042C: "CP1254", 0x082C: "CP1251", 0x0443: "CP1254", 0x0843: "CP1251", 0x0444: "CP1251", 0x042F: "CP1251", 0x0409: "CP1252"}
_WESTERN = (
    [0x0403, 0x0406, 0x0407, 0x0409, 0x040B, 0x040C, 0x040F, 0x0410, 0x0413, 0x0414, 0x0416, 0x041D, 0x0421, 0x042D, 0x0432, 0x0434, 0x0435, 0x0436, 0x0438, 0x043E, 0x0441]
    + [0x0807, 0x0809, 0x080C, 0x0810, 0x0813, 0x0814, 0x0816, 0x081D, 0x083E, 0x0C07, 0x0C09, 0x0C0C, 0x1007, 0x1009, 0x100C, 0x1407, 0x1409, 0x140C, 0x1809, 0x1C09, 0x2009, 0x2409, 0x2809, 0x2C09, 0x3409]
    + [0x0400 * k + 0x0A for k in range(2, 21)]
)
#: Locales that archives of this kind don't know; they get the default.
_LATER = {0x101A, 0x0437, 0x0820}
DEFAULT = "UTF-8"


def _table() -> dict[int, str]:
    by_language = {lang: page for page, langs in _PAGES.items() for lang in langs}
    out = {i: "CP1252" for i in _WESTERN}
    for lcid, name in windows_locale.items():
        page = by_language.get(name.split("_")[0])
        if page and lcid < 0x10000 and lcid not in _LATER:
            out[lcid] = page
    return out | _SPECIAL


CHARSETS = _table()


def charset_of(lcid: int) -> str:
    return CHARSETS.get(lcid, DEFAULT)


_ALIAS = {"GB2313": "gb2312", "EUCKR": "euc_kr", "TIS-620": "tis_620", "SHIFT-JIS": "shift_jis"}


def _codec(charset: str) -> str:
    """Unknown character sets are read as UTF-8."""
    try:
        return codecs.lookup(_ALIAS.get(charset.upper(), charset)).name
    except LookupError:
        return "utf-8"


def decode(data: bytes, charset: str) -> str:
    """Bytes that don't fit become U+FFFD."""
    return data.decode(_codec(charset), "replace")


def encode(text: str, charset: str) -> bytes | None:
    """The bytes that are read as this text; None if there are none."""
    try:
        return text.encode(_codec(charset))
    except UnicodeEncodeError:
        return None
