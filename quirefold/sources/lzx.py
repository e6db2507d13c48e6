"""LZX decompression, one reset interval at a time."""

from __future__ import annotations

_CHARS, _MIN_MATCH, _PRIMARY, _LENGTHS = 256, 2, 7, 249
_EXTRA = [0, 0, 0, 0]
while len(_EXTRA) < 51:
    _EXTRA.append(min(17, (len(_EXTRA) - 2) // 2))
_BASE = [0]
for _x in _EXTRA[:50]:
    _BASE.append(_BASE[-1] + (1 << _x))


class LzxError(ValueError):
    """The stream breaks the format."""


class _Bits:
    """16-bit little-endian words, most significant bit first; zeros past the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0
        self._swapped: bytes | None = None

    def swapped(self) -> bytes:
        """The data with the bytes of each word in the order of their bits."""
        if self._swapped is None:
            own = self.data + bytes(len(self.data) % 2)
            out = bytearray(len(own))
            out[::2], out[1::2] = own[1::2], own[::2]
            self._swapped = bytes(out)
        return self._swapped

    def need(self, n: int) -> None:
        while self.have < n:
            word = int.from_bytes(self.data[self.at : self.at + 2], "little")
            self.at += 2
            self.value = (self.value << 16 | word) & (1 << (self.have + 16)) - 1
            self.have += 16

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.have -= n
        out = self.value >> self.have
        self.value &= (1 << self.have) - 1
        return out


class _Tree:
    """Canonical prefix code by lengths; a table of all 16-bit openings."""

    def __init__(self, lengths: list[int]):
        longest = max(lengths, default=0)
        self.width, self.table = longest, []
        if not longest:
            return
        table: list[tuple[int, int]] = []
        for n in range(1, longest + 1):
            for sym, have in enumerate(lengths):
                if have == n:
                    table.extend([(sym, n)] * (1 << (longest - n)))
        if len(table) != 1 << longest:
            raise LzxError("a code is not complete")
        self.table = table

    def read(self, bits: _Bits) -> int:
        if not self.table:
            raise LzxError("a symbol of an empty code")
        bits.need(16)
        sym, n = self.table[bits.value >> (bits.have - self.width)]
        bits.have -= n
        bits.value &= (1 << bits.have) - 1
        return sym


class Inflator:
    """State over the blocks of a reset interval: window, recent offsets, code lengths."""

    def __init__(self, window_bits: int):
        if not 15 <= window_bits <= 21:
            raise LzxError("the window must have 2^15 to 2^21 bytes")
        self.size = 1 << window_bits
        slots = {20: 42, 21: 50}.get(window_bits, 2 * window_bits)
        self.main_symbols = _CHARS + 8 * slots
        self.reset()

    def reset(self) -> None:
        self.recent = [1, 1, 1]
        self.out = bytearray()  # everything since the reset; the window is its end
        self.main, self.length = [0] * self.main_symbols, [0] * _LENGTHS
        self.kind = self.left = self.block = self.translate_size = self.frames = 0
        self.begun = self.translating = False

    def _lengths(self, bits: _Bits, into: list[int], a: int, b: int) -> None:
        tree = _Tree([bits.take(4) for _ in range(20)])
        while a < b:
            z = tree.read(bits)
            run, value = 1, None
            if z == 17:
                run, value = bits.take(4) + 4, 0
            elif z == 18:
                run, value = bits.take(5) + 20, 0
            elif z == 19:
                run = bits.take(1) + 4
                z = tree.read(bits)
            if value is None:
                value = (into[a] - z) % 17
            for i in range(a, min(a + run, b)):
                into[i] = value
            a += run

    def _begin_block(self, bits: _Bits) -> None:
        if self.kind == 3 and self.block & 1 and bits.at:
            bits.at += 1  # the stream goes on at a whole word
        self.kind = bits.take(3)
        self.left = self.block = bits.take(16) << 8 | bits.take(8)
        if self.kind in (1, 2):
            if self.kind == 2:
                self.aligned = _Tree([bits.take(3) for _ in range(8)])
            self._lengths(bits, self.main, 0, _CHARS)
            self._lengths(bits, self.main, _CHARS, self.main_symbols)
            self._lengths(bits, self.length, 0, _LENGTHS)
            self.main_tree, self.length_tree = _Tree(self.main), _Tree(self.length)
            self.translating |= self.main[0xE8] != 0
        elif self.kind == 3:
            self.translating = True
            bits.need(16)
            if bits.have > 16:
                bits.at -= 2
            bits.value = bits.have = 0
            self.recent = [int.from_bytes(bits.data[bits.at + 4 * i : bits.at + 4 * i + 4], "little") for i in range(3)]
            bits.at += 12
        else:
            raise LzxError("unknown block type")

    def _compressed(self, bits: _Bits, n: int) -> None:
        out, stop, size_of_window, is_aligned = self.out, len(self.out) + n, self.size, self.kind == 2
        main, main_width, lengths, lengths_width = self.main_tree.table, self.main_tree.width, self.length_tree.table, self.length_tree.width
        if not main:
            raise LzxError("a symbol of an empty code")
        # bits are kept in locals here and taken three words at a time; whole words that are left over go back at the end
        data, at, value, have = bits.swapped(), bits.at, bits.value, bits.have
        r0, r1, r2 = self.recent
        while len(out) < stop:
            if have < 16:
                value, have, at = value << 48 | int.from_bytes(data[at : at + 6].ljust(6, b"\0"), "big"), have + 48, at + 6
            sym, k = main[value >> (have - main_width)]
            have -= k
            value &= (1 << have) - 1
            if sym < _CHARS:
                out.append(sym)
                continue
            if have < 48:  # enough for a length, an offset and its aligned bits
                value, have, at = value << 48 | int.from_bytes(data[at : at + 6].ljust(6, b"\0"), "big"), have + 48, at + 6
            sym -= _CHARS
            size, slot = (sym & _PRIMARY) + _MIN_MATCH, sym >> 3
            if size == _PRIMARY + _MIN_MATCH:
                if not lengths:
                    raise LzxError("a symbol of an empty code")
                more, k = lengths[value >> (have - lengths_width)]
                have -= k
                value &= (1 << have) - 1
                size += more
            if slot == 1:
                r0, r1 = r1, r0
            elif slot == 2:
                r0, r2 = r2, r0
            elif slot:
                extra, low = _EXTRA[slot], 0
                if is_aligned and extra >= 3:
                    have -= extra - 3
                    low = value >> have << 3
                    value &= (1 << have) - 1
                    if not self.aligned.table:
                        raise LzxError("a symbol of an empty code")
                    more, k = self.aligned.table[value >> (have - self.aligned.width)]
                    have -= k
                    low += more
                else:
                    have -= extra
                    low = value >> have
                value &= (1 << have) - 1
                r0, r1, r2 = _BASE[slot] + low - 2, r0, r1
            if r0 < 1 or r0 > size_of_window:
                raise LzxError("an offset leaves the window")
            src = len(out) - r0
            if src < 0:  # before the first byte the window holds zeros
                blank = min(size, -src)
                out.extend(bytes(blank))
                size, src = size - blank, src + blank
            while size > 0:
                part = out[src : src + size]
                out += part
                size, src = size - len(part), src + len(part)
        while have >= 16:
            value, have, at = value >> 16, have - 16, at - 2
        bits.value = value
        bits.have, bits.at, self.recent = have, at, [r0, r1, r2]

    def inflate(self, data: bytes, n: int) -> bytes:
        """The next n bytes, of one compressed block."""
        bits = _Bits(data)
        if not self.begun:
            self.translate_size = bits.take(16) << 16 | bits.take(16) if bits.take(1) else 0
            self.begun = True
        start, todo = len(self.out), n
        while todo > 0:
            if not self.left:
                self._begin_block(bits)
            now = min(todo, self.left)
            if self.kind == 3:
                part = bits.data[bits.at : bits.at + now]
                self.out += part + bytes(now - len(part))
                bits.at += now
            else:
                before = len(self.out)
                self._compressed(bits, now)
                now = len(self.out) - before  # a match may run over the block's end
            self.left = max(0, self.left - now)
            todo -= now
        out = bytes(self.out[start : start + n])
        frame, self.frames = self.frames, self.frames + 1
        if self.translate_size and self.translating and frame < 32768 and n > 10:
            out = self._calls(bytearray(out), start)
        return out

    def _calls(self, out: bytearray, position: int) -> bytes:
        """Undoes the translation of call targets (byte E8 and a 32-bit number)."""
        at, stop, size = 0, len(out) - 10, self.translate_size
        while 0 <= (at := out.find(0xE8, at, stop)):
            here = position + at
            absolute = int.from_bytes(out[at + 1 : at + 5], "little", signed=True)
            if -here <= absolute < size:
                relative = absolute - here if absolute >= 0 else absolute + size
                out[at + 1 : at + 5] = (relative & 0xFFFFFFFF).to_bytes(4, "little")
            at += 5
        return bytes(out)
