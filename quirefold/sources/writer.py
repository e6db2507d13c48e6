"""A writer of help archives: stored objects, LZX blocks of all types, metadata, word index (two levels of nodes)."""

import struct
from bisect import bisect_right

import numpy as np


def encint(n):
    out = [n & 0x7F]
    n >>= 7
    while n:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(reversed(out))


def bits_of(value, n):
    """The lowest n bits as a string."""
    return f"{value & (1 << n) - 1:0{n}b}" if n else ""


class WordBits:
    """16-bit little-endian words, most significant bit first; kept as strings of bits until they are bytes."""

    def __init__(self):
        self.bits, self.out = [], b""

    def put(self, value, n):
        self.bits.append(bits_of(value, n))

    def align(self):
        # a full word of padding if already aligned, as the format has it before stored bytes
        self.bits.append("0" * (16 - sum(map(len, self.bits)) % 16))

    def raw(self, data):
        assert sum(map(len, self.bits)) % 16 == 0
        self.out, self.bits = self.bytes() + data + bytes(len(data) % 2), []

    def bytes(self):
        b = "".join(self.bits)
        b += "0" * (-len(b) % 16)
        own = int(b or "0", 2).to_bytes(len(b) // 8, "big")
        words = bytearray(len(own))
        words[::2], words[1::2] = own[1::2], own[::2]
        return self.out + bytes(words)


def codes_of(lengths):
    """Canonical codes: by length, then symbol."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (code, n)
        code += 1
    return out


EXTRA = [0, 0, 0, 0]
while len(EXTRA) < 51:
    EXTRA.append(min(17, (len(EXTRA) - 2) // 2))
BASE = [0]
for _x in EXTRA[:50]:
    BASE.append(BASE[-1] + (1 << _x))
#: Matches reach back less than the decoder's window of 0x8000.
WINDOW = 0x7F00
MAIN = 256 + 8 * 30
LENGTHS_MAIN = [8] * 16 + [9] * (MAIN - 16)
LENGTHS_LEN = [7] * 7 + [8] * 242
ALIGNED = [3] * 8
MAIN_BITS, LENGTH_BITS, ALIGNED_BITS = ([bits_of(*c) for _, c in sorted(codes_of(lengths).items())] for lengths in (LENGTHS_MAIN, LENGTHS_LEN, ALIGNED))


class Encoder:
    """Blocks of 32 KiB in a window of the same size; keeps the state that runs over blocks."""

    def __init__(self, e8_size=0):
        self.recent, self.done, self.first, self.e8 = [1, 1, 1], b"", True, e8_size
        self.main, self.length = [0] * MAIN, [0] * 249

    def _lens(self, w, have, want):
        deltas = [(h - x) % 17 for h, x in zip(have, want)]
        used = sorted(set(deltas))
        used += [s for s in range(17) if s not in used][: max(0, 2 - len(used))]
        n = max(1, (len(used) - 1).bit_length())
        short = (1 << n) - len(used)
        pre = [0] * 20
        for i, s in enumerate(used):
            pre[s] = n - 1 if i < short else n
        for x in pre:
            w.put(x, 4)
        c = codes_of(pre)
        for d in deltas:
            w.put(*c[d])

    def block(self, data, kind):
        w = WordBits()
        if self.first:
            w.put(1 if self.e8 else 0, 1)
            if self.e8:
                w.put(self.e8 >> 16, 16)
                w.put(self.e8 & 0xFFFF, 16)
            self.first = False
        w.put(kind, 3)
        w.put(len(data) >> 8, 16)
        w.put(len(data) & 255, 8)
        if kind == 3:
            w.align()
            w.raw(struct.pack("<III", *self.recent))
            w.raw(data)
        else:
            if kind == 2:
                for x in ALIGNED:
                    w.put(x, 3)
            self._lens(w, self.main[:256], LENGTHS_MAIN[:256])
            self._lens(w, self.main[256:], LENGTHS_MAIN[256:])
            self._lens(w, self.length, LENGTHS_LEN)
            self.main, self.length = list(LENGTHS_MAIN), list(LENGTHS_LEN)
            self._body(w, data, kind)
        self.done += data
        return w.bytes()

    def _body(self, w, data, kind):
        all_, start = self.done + data, len(self.done)
        keys, earlier = _places(all_, start)
        put, (r0, r1, r2), at, end = w.bits.append, self.recent, start, len(all_)
        while at < end:
            # a match of less than 3 bytes isn't taken; one by a recent offset goes before another of its length
            best, where, key, most = 0, 0, keys[at], min(257, end - at)
            if key >= 0:
                for back in (r0, r1, r2, at - earlier[at - start]):
                    if back > at or keys[at - back] != key:
                        continue
                    n = _common(all_, at - back, at, most)
                    if n > best:
                        best, where = n, back
            if not best:
                put(MAIN_BITS[all_[at]])
                at += 1
                continue
            if where == r0:
                slot = 0
            elif where == r1:
                slot, r0, r1 = 1, r1, r0
            elif where == r2:
                slot, r0, r2 = 2, r2, r0
            else:
                slot, r0, r1, r2 = bisect_right(BASE, where + 2, 3, 30) - 1, where, r0, r1
            head = min(best - 2, 7)
            put(MAIN_BITS[256 + (slot << 3 | head)])
            if head == 7:
                put(LENGTH_BITS[best - 9])
            if slot >= 3:
                low, extra = where + 2 - BASE[slot], EXTRA[slot]
                if kind == 2 and extra >= 3:
                    put(bits_of(low >> 3, extra - 3))
                    put(ALIGNED_BITS[low & 7])
                else:
                    put(bits_of(low, extra))
            at += best
        self.recent = [r0, r1, r2]


def _places(all_, start):
    """(keys, earlier): three bytes from each place on as a number, below 0 for the last two places; for places from `start` on the last place before with the same three within the window, or -1. Three bytes that run into `start` don't count as earlier ones."""
    b = np.frombuffer(all_, np.uint8).astype(np.int32)
    n = len(b)
    keys = np.full(n, -1, np.int32)
    if n > 2:
        keys[:-2] = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    own = keys.copy()
    own[max(0, start - 2) : start] = -1
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    before[np.arange(n) - before > WINDOW] = -1
    before[own < 0] = -1
    return keys.tolist(), before[start:].tolist()


def _common(data, a, b, most):
    """How many bytes from a and from b on are the same, up to `most`."""
    n = 3
    for step in (8, 32, 257):
        stop = min(n + step, most)
        x, y = data[a + n : a + stop], data[b + n : b + stop]
        if x != y:
            d = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + (((d & -d).bit_length() - 1) >> 3)
        n = stop
        if n == most:
            break
    return n


def lzx_section(data, kinds, interval=2, e8_size=0):
    """(compressed, reset table, control data) of data cut into blocks of 0x8000."""
    size = 0x8000
    blocks, offsets, at, enc = [], [], 0, None
    for n, i in enumerate(range(0, len(data), size)):
        if n % interval == 0:
            enc = Encoder(e8_size)
        offsets.append(at)
        b = enc.block(data[i : i + size].ljust(size, b"\0"), kinds[n % len(kinds)])
        blocks.append(b)
        at += len(b)
    comp = b"".join(blocks)
    table = struct.pack("<IIIIQQQ", 2, len(offsets), 8, 0x28, len(data), len(comp), size) + b"".join(struct.pack("<Q", o) for o in offsets)
    # interval / (window / 2) * windows per reset: window 0x8000, so interval 0x4000 units of half a window
    control = struct.pack("<I4sIIIII", 6, b"LZXC", 1, 0x4000 * interval, 0x8000, 1, 0)
    return comp, table, control


def system(records):
    return struct.pack("<I", 3) + b"".join(struct.pack("<HH", k, len(v)) + v for k, v in records)


def write_chm(path, stored, compressed=(), kinds=(3,), version=3, lang=0x409, page_size=0x1000, e8_size=0, interval=2):
    """stored: (path, bytes) of section 0; compressed: those of section 1."""
    entries, data = [], b""
    for name, body in stored:
        entries.append((name, 0, len(data), len(body)))
        data += body
    if compressed:
        stream = b""
        for name, body in compressed:
            entries.append((name, 1, len(stream), len(body)))
            stream += body
        comp, table, control = lzx_section(stream, kinds, interval, e8_size)
        base = "::DataSpace/Storage/MSCompressed/"
        for name, body in (("ControlData", control), ("Content", comp), ("Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable", table)):
            entries.append((base + name, 0, len(data), len(body)))
            data += body
    pages, now = [], b""
    for name, space, start, n in entries:
        raw = name.encode()
        e = encint(len(raw)) + raw + encint(space) + encint(start) + encint(n)
        if len(now) + len(e) > page_size - 0x14:
            pages.append(now)
            now = b""
        now += e
    pages.append(now)
    out = b""
    for i, p in enumerate(pages):
        nxt = i + 1 if i + 1 < len(pages) else -1
        out += struct.pack("<4siiii", b"PMGL", page_size - 0x14 - len(p), 0, i - 1, nxt) + p.ljust(page_size - 0x14, b"\0")
    itsp = struct.pack("<4siiiiiiiiiiii", b"ITSP", 1, 0x54, 10, page_size, 2, 1, -1, 0, len(pages) - 1, -1, len(pages), lang).ljust(0x54, b"\0")
    directory = itsp + out
    head_len = 0x60 if version >= 3 else 0x58
    head = struct.pack("<4siiiiI", b"ITSF", version, head_len, 1, 0, lang).ljust(0x48, b"\0")
    dir_at = head_len
    head += struct.pack("<QQ", dir_at, len(directory))
    if version >= 3:
        head += struct.pack("<Q", dir_at + len(directory))
    with open(path, "wb") as f:
        f.write(head + directory + data)


class ByteBits:
    def __init__(self):
        self.bits, self.n = [], 0

    def scaled(self, v, root):
        if v < 1 << root:
            b = "0" + bits_of(v, root)
        else:
            n = v.bit_length() - 1  # the top bit is implied
            b = "1" * (n - root + 1) + "0" + bits_of(v, n)
        self.bits.append(b)
        self.n += len(b)

    def align(self):
        self.bits.append("0" * (-self.n % 8))
        self.n += -self.n % 8

    def bytes(self):
        return int("".join(self.bits) or "0", 2).to_bytes(self.n // 8, "big")


def word_index(postings, topics, leaf_words=2, roots=(2, 1, 3), node=256, encoding="latin-1"):
    """Objects of a word index. postings: {(word, context): {doc: [positions]}}; topics: (url, title) by document."""
    head, lists = bytearray(0x400), b""
    entries = []
    for (word, context), docs in sorted(postings.items()):
        b, last = ByteBits(), 0
        for d in sorted(docs):
            b.scaled(d - last, roots[0])
            last = d
            b.scaled(len(docs[d]), roots[1])
            p0 = 0
            for p in docs[d]:
                b.scaled(p - p0, roots[2])
                p0 = p
            b.align()
        body = b.bytes()
        entries.append((word, context, len(docs), 0x400 + len(lists), body))
        lists += body
    leaves = [entries[i : i + leaf_words] for i in range(0, len(entries), leaf_words)]
    at0 = 0x400 + len(lists)
    blob, index = b"", b""
    for i, leaf in enumerate(leaves):
        body, last = b"", b""
        for word, context, count, where, raw in leaf:
            w = word.encode(encoding)
            keep = 0
            while keep < min(len(w), len(last)) and w[keep] == last[keep]:
                keep += 1
            body += bytes([len(w) - keep + 1, keep]) + w[keep:] + bytes([context]) + encint(count) + struct.pack("<IH", where, 0) + encint(len(raw))
            last = w
        nxt = at0 + (i + 1) * node if i + 1 < len(leaves) else 0
        assert len(body) <= node - 8
        blob += struct.pack("<IHH", nxt, 0, node - 8 - len(body)) + body.ljust(node - 8, b"\0")
        index += bytes([len(last) + 1, 0]) + last + struct.pack("<IH", at0 + i * node, 0)
    depth, root = 1, at0
    if len(leaves) > 1:
        depth, root = 2, at0 + len(blob)
        blob += struct.pack("<H", node - 2 - len(index)) + index.ljust(node - 2, b"\0")
    struct.pack_into("<IH", head, 0x14, root, depth)
    struct.pack_into("<6B", head, 0x1E, 2, roots[0], 2, roots[1], 2, roots[2])
    struct.pack_into("<I", head, 0x2E, node)
    struct.pack_into("<I", head, 0x3E, 64)
    strings, url_str, url_tbl, topic = b"\0", b"", b"", b""
    for url, title in topics:
        t_at = len(strings)
        strings += title.encode(encoding) + b"\0"
        u_at = len(url_str)
        url_str += struct.pack("<II", 0, 0) + url.encode(encoding) + b"\0"
        topic += struct.pack("<IiiI", 0, t_at, len(url_tbl), 0)
        url_tbl += struct.pack("<IIi", 0, 0, u_at)
    return [("/$FIftiMain", bytes(head) + lists + blob), ("/#TOPICS", topic), ("/#STRINGS", strings), ("/#URLTBL", url_tbl), ("/#URLSTR", url_str)]
