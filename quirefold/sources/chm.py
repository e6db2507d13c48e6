"""Reader of compiled help archives: container, directory, metadata, objects, contents tree, built-in word index."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

from quirefold.sources.charsets import DEFAULT, charset_of, decode, encode
from quirefold.sources.lzx import Inflator, LzxError

RESET_TABLE = "::dataspace/storage/mscompressed/transform/{7fc28940-9d31-11d0-9b27-00a0c91e9c7c}/instancedata/resettable"
CONTENT = "::dataspace/storage/mscompressed/content"
CONTROL = "::dataspace/storage/mscompressed/controldata"
CONTENTS = "/@contents"


class ChmError(ValueError):
    """The file is no archive of this kind, or is damaged."""


def encint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position) of a big-endian number of 7-bit groups."""
    value = 0
    while True:
        b = data[at]
        at += 1
        value = value << 7 | b & 0x7F
        if b < 0x80:
            return value, at


def flags_of(path: str) -> int:
    if path.endswith((".hhc", ".hhk")):
        return 2
    kind = 2 if not path.startswith("/") else 4 if path.startswith(("/#", "/$")) else 1
    return kind | (16 if path.endswith("/") else 8)


def c_string(data: bytes, charset: str) -> str:
    return decode(data.split(b"\x00", 1)[0], charset)


class Unit:
    __slots__ = ("flags", "length", "ord", "path", "space", "start")

    def __init__(self, ord_: int, path: str, space: int, start: int, length: int):
        self.ord, self.path, self.space, self.start, self.length, self.flags = ord_, path, space, start, length, flags_of(path)


class Archive:
    """One open file. Objects in compressed space are decoded by reset interval, each once while it is in use."""

    def __init__(self, path: str):
        self.name = path
        self.file = open(path, "rb")  # noqa: SIM115
        try:
            self._open()
        except (struct.error, IndexError, LzxError) as e:
            raise ChmError(f"{path}: {e}") from e

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _open(self) -> None:
        head = self._read(0, 0x60)
        if head[:4] != b"ITSF":
            raise ChmError(f"{self.name}: not an archive of this kind")
        version, self.lang_id = struct.unpack_from("<i12xI", head, 4)
        dir_at, dir_len = struct.unpack_from("<QQ", head, 0x48)
        self.data_at = struct.unpack_from("<Q", head, 0x58)[0] if version >= 3 else dir_at + dir_len
        self._directory(dir_at)
        self._compression()
        self._metadata()

    def _directory(self, at: int) -> None:
        head = self._read(at, 0x54)
        if head[:4] != b"ITSP":
            raise ChmError(f"{self.name}: no directory header")
        head_len, _, block_len = struct.unpack_from("<iii", head, 8)
        first = struct.unpack_from("<i", head, 0x20)[0]
        self.units: dict[str, Unit] = {}
        self.entries: list[Unit] = []
        page, seen = first, set()
        while page != -1 and page not in seen:
            seen.add(page)
            block = self._read(at + head_len + page * block_len, block_len)
            if block[:4] != b"PMGL":
                raise ChmError(f"{self.name}: no directory page")
            free, page = struct.unpack_from("<i8xi", block, 4)
            p, stop = 0x14, block_len - free
            while p < stop:
                n, p = encint(block, p)
                path = block[p : p + n].decode("utf-8", "replace")
                p += n
                space, p = encint(block, p)
                start, p = encint(block, p)
                length, p = encint(block, p)
                unit = Unit(len(self.entries), path, space, start, length)
                self.entries.append(unit)
                key = path.lower()
                self.units[key] = unit
                if key.endswith(".hhc"):
                    self.units[CONTENTS] = unit

    def unit(self, path: str) -> Unit | None:
        return self.units.get(path.lower())

    def _compression(self) -> None:
        table, content, control = self.unit(RESET_TABLE), self.unit(CONTENT), self.unit(CONTROL)
        self.compressed = False
        if not all(u is not None and u.space == 0 for u in (table, content, control)):
            return
        raw, ctl = self.content(table), self.content(control)
        if raw is None or len(raw) < 0x28 or ctl is None:
            return
        if ctl[4:8] != b"LZXC":
            raise ChmError(f"{self.name}: no control data")
        version, interval, window, per_reset = struct.unpack_from("<iiii", ctl, 8)
        if version == 2:
            interval, window = interval * 0x8000, window * 0x8000
        self.interval = max(1, interval // (window // 2) * per_reset)
        self.window_bits = window.bit_length() - 1
        _, count, _, table_at = struct.unpack_from("<iiii", raw, 0)
        _, compressed_len, self.block_len = struct.unpack_from("<QQQ", raw, 16)
        offsets = struct.unpack_from(f"<{count}Q", raw, table_at)
        base = self.data_at + content.start
        self.offsets = [*(base + o for o in offsets), base + compressed_len]
        self.compressed = True
        self._interval = lru_cache(2)(self._decode_interval)

    def _decode_interval(self, number: int) -> list[bytes]:
        """Blocks of a reset interval; those after a damaged one are missing."""
        inflator, out = Inflator(self.window_bits), []
        for b in range(number * self.interval, min((number + 1) * self.interval, len(self.offsets) - 1)):
            try:
                out.append(inflator.inflate(self._read(self.offsets[b], self.offsets[b + 1] - self.offsets[b]), self.block_len))
            except (LzxError, IndexError):
                break
        return out

    def content(self, unit: Unit | None, at: int = 0, n: int | None = None) -> bytes | None:
        """Bytes of an object from `at` on; None for none, an address outside, or what can't be decoded."""
        if unit is None or at < 0 or at >= unit.length:
            return None
        n = unit.length - at if n is None else min(n, unit.length - at)
        if unit.space == 0:
            return self._read(self.data_at + unit.start + at, n)
        if not self.compressed:
            return None
        parts, at, stop = [], unit.start + at, unit.start + at + n
        while at < stop:
            block, skip = divmod(at, self.block_len)
            own = self._interval(block // self.interval)
            if block % self.interval >= len(own):
                break
            part = own[block % self.interval][skip : skip + stop - at]
            parts.append(part)
            at += len(part)
        return b"".join(parts) if parts else None

    def _metadata(self) -> None:
        self.title = self.home = self.topics_file = self.index_file = self.generator = self.encoding = None
        self.lcid = None
        data = self.content(self.unit("/#SYSTEM")) or b""
        at = 4
        while at + 4 <= len(data):
            kind, n = struct.unpack_from("<HH", data, at)
            body = data[at + 4 : at + 4 + n]
            text = lambda: c_string(body, self.encoding or DEFAULT)  # noqa: B023, E731
            if kind == 0:
                self.topics_file = "/" + text()
            elif kind == 1:
                self.index_file = "/" + text()
            elif kind == 2:
                self.home = "/" + text()
            elif kind == 3:
                self.title = text()
            elif kind == 4 and n >= 4:
                self.lcid = struct.unpack_from("<I", body, 0)[0]
                self.encoding = charset_of(self.lcid)
            elif kind == 9:
                self.generator = text()
            at += 4 + n
        self.home = self.home or ""
        if self.home == "/":
            self.home = next((p for p in ("/cover.html", "/cover.htm", "/index.html", "/index.htm") if self.unit(p)), "/")
        self.title = self.title or re.sub(r".*[\\/]|\.[^.]*$", "", re.sub(r"[.][^.]+$", "", os.path.basename(self.name)))
        own = charset_of(self.lang_id)
        if not self.encoding or self.encoding.startswith("CP") and not own.startswith("CP"):
            self.encoding = own
        self.topics_file, self.index_file, self.generator = self.topics_file or "", self.index_file or "", self.generator or ""

    def text(self, unit: Unit | None) -> str | None:
        data = self.content(unit)
        return None if data is None else decode(data, self.encoding)

    @property
    def searchable(self) -> bool:
        """Whether it has a word index of its own that can be read."""
        try:
            return WordIndex(self).usable
        except (struct.error, IndexError):
            return False


class ByteBits:
    """Bits of bytes, most significant first; zeros past the end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0
            value = value << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def scaled(self, root: int) -> int:
        """A number coded by scale and root, of scale 2."""
        ones = 0
        while self.take(1):
            ones += 1
            if ones > 64:
                raise ChmError("a number is too long")
        n = root + max(0, ones - 1)
        value = self.take(n)
        return value | 1 << n if ones else value

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


class WordIndex:
    """The word index of an archive: a tree of words; each leaf entry leads to its documents and positions."""

    def __init__(self, archive: Archive):
        self.a = archive
        self.main = archive.unit("/$FIftiMain")
        self.parts = [archive.unit(p) for p in ("/#TOPICS", "/#STRINGS", "/#URLTBL", "/#URLSTR")]
        head = archive.content(self.main, 0, 0x82)
        self.usable = False
        if head is None or len(head) < 0x32 or any(p is None for p in self.parts):
            return
        self.root, self.depth = struct.unpack_from("<IH", head, 0x14)
        s1, self.doc_root, s2, self.count_root, s3, self.place_root = struct.unpack_from("<6B", head, 0x1E)
        self.node_len = struct.unpack_from("<I", head, 0x2E)[0]
        self.usable = (s1, s2, s3) == (2, 2, 2)

    def _first_leaf(self) -> int:
        """The leftmost leaf: the first child at each level."""
        at = self.root
        for _ in range(self.depth - 1):
            node = self.a.content(self.main, at, self.node_len)
            if node is None:
                return 0
            n = node[2]
            at = struct.unpack_from("<I", node, 4 + n - 1)[0]
        return at

    def _leaf_of(self, wanted: bytes) -> int:
        """The leaf in which `wanted`, or the first word after it, stands: an entry of an upper node names the last word of its child. 0 if all words are smaller."""
        at = self.root
        for _ in range(self.depth - 1):
            node = self.a.content(self.main, at, self.node_len)
            if node is None:
                return 0
            end = self.node_len - struct.unpack_from("<H", node, 0)[0]
            p, word, child = 2, b"", 0
            while p < end and not child:
                n, keep = node[p], node[p + 1]
                word = word[:keep] + node[p + 2 : p + 1 + n]
                if word >= wanted:
                    child = struct.unpack_from("<I", node, p + 1 + n)[0]
                p += n + 7
            if not child:
                return 0
            at = child
        return at

    def entries(self, start: str | None = None, whole: bool = False) -> Iterator[tuple[str, int, int, int, int]]:
        """(word, context, documents, where their list is, its size), leaf by leaf; with `start` only of that word, or of what begins with it: the tree is gone down to it and left behind the last."""
        wanted = encode(start, self.a.encoding) if start else None
        at, seen = (self._first_leaf() if wanted is None else self._leaf_of(wanted)) if self.usable else 0, set()
        while at and at not in seen:
            seen.add(at)
            node = self.a.content(self.main, at, self.node_len)
            if node is None:
                return
            at, free = struct.unpack_from("<I2xH", node, 0)
            p, word = 8, b""
            while p < self.node_len - free:
                n, keep = node[p], node[p + 1]
                word = word[:keep] + node[p + 2 : p + 1 + n]
                p += 1 + n
                context = node[p]
                count, p = encint(node, p + 1)
                where = struct.unpack_from("<I", node, p)[0]
                size, p = encint(node, p + 6)
                if wanted is None or word == wanted or (not whole and word.startswith(wanted)):
                    yield decode(word, self.a.encoding), context, count, where, size
                elif word > wanted:
                    return

    def documents(self, count: int, where: int, size: int) -> Iterator[tuple[int, list[int]]]:
        """(number, positions) of each document in a list."""
        bits, doc = ByteBits(self.a.content(self.main, where, size) or b""), 0
        for _ in range(count):
            doc += bits.scaled(self.doc_root)
            places, last = [], 0
            for _ in range(bits.scaled(self.count_root)):
                last += bits.scaled(self.place_root)
                places.append(last)
            bits.align()
            yield doc, places

    def topic(self, number: int) -> tuple[str, str] | None:
        """(url, title) of a document."""
        topics, strings, url_table, url_strings = self.parts
        entry = self.a.content(topics, number * 16, 16)
        if entry is None or len(entry) < 12:
            return None
        title_at, url_at = struct.unpack_from("<ii", entry, 4)
        title = self.a.content(strings, title_at, 1024)
        row = self.a.content(url_table, url_at, 12)
        if row is None or len(row) < 12:
            return None
        url = self.a.content(url_strings, struct.unpack_from("<i", row, 8)[0] + 8, 1024)
        if url is None:
            return None
        url_text = c_string(url, self.a.encoding)
        topic = c_string(title, self.a.encoding) if title else ""
        return ("/" + url_text, topic or url_text) if url_text else None

    def postings(self, start: str | None = None, whole: bool = False) -> Iterator[tuple[str, int, int, list[int]]]:
        for word, context, count, where, size in self.entries(start, whole):
            for doc, places in self.documents(count, where, size):
                yield word, context, doc, places


_TAG = re.compile(r"<((?:[^>=]|=\s*\"[^\"]*\"|=)*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*\"([^\"]*)\"")


def parse_contents(text: str) -> list[tuple[int, int | None, int, int, str, str]]:
    """(id, parent, place among its siblings, level, title, path) of a contents file; the root has id 0 and comes first."""
    rows: list[list] = [[0, None, 0, 0, "<Top>", ""]]
    root = last = 0
    depth, children, inside = 0, {0: 0}, False
    for m in _TAG.finditer(text):
        body = m[1].strip()
        if body.startswith(("!", "?")) or not body:
            continue
        name = body.split(None, 1)[0].lower()
        attrs = {k.lower(): v for k, v in _ATTRIBUTE.findall(body)}
        if name == "ul":
            depth += 1
            if depth > 1:
                root = last
        elif name == "/ul":
            depth -= 1
            if depth > 0 and rows[root][1] is not None:
                last, root = root, rows[root][1]
        elif name == "object" and attrs.get("type", "").lower() == "text/sitemap":
            last = len(rows)
            rows.append([last, root, children[root], rows[root][3] + 1, "", ""])
            children[root] += 1
            children[last] = 0
            inside = True
        elif name == "/object":
            inside = False
        elif name == "param" and inside:
            value = attrs.get("value", "")
            if attrs.get("name") == "Name":
                rows[last][4] = value
            elif attrs.get("name") == "Local":
                rows[last][5] = "/" + value.removeprefix("./")
    return [tuple(r) for r in rows]
