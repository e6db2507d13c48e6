"""FLAC media columns: an encoder for 8-bit payloads and a decoder for streams of any kind.

The decoder reads STREAMINFO, finds the frames by their headers (sync code, CRC-8), verifies each frame's CRC-16
and decodes constant, verbatim, fixed and linear-predictor subframes with Rice residuals (both parameter widths,
escapes, wasted bits, stereo decorrelation). All frames of a batch are decoded side by side: step i decodes
residual i of every frame in a few numpy operations, so the work is vectorised across frames, not across bits.
The samples are checked with the stream's MD5.

The encoder packs a batch in the same way: blocks of BLOCK samples, per frame the smallest of constant, verbatim,
fixed predictors of order 0 to 2 and a linear predictor of order ORDER (autocorrelation, Levinson-Durbin,
coefficients of PRECISION bits) with one Rice parameter; a seek table with an entry for each frame.

Decoding gives PCM blocks with the number of their first sample, frame after frame; no more than LANES frames are
unpacked at a time, so a stream of any length needs little beyond its own size. PcmBlocks reads any range of samples
by their offsets, and read_samples decodes only the frames that the seek table names for a range. media_columns reads
the stored bytes back that way; write_pcm_blocks turns a column of streams into a table of blocks.

One narrow pass, no shuffle; memory is bounded by the slice. Nulls: a null text is empty, its payload 64 zero
bytes; a null stream gives no blocks; null ids are kept. Empty table: no rows. Repeated rows: equal values.
Further columns are ignored. A damaged stream raises an error that names the fault.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.common import ship, table
from quirefold.llm import textcore as tc

BLOCK, RATE, UNIT = 1024, 8000, 64
ORDER, PRECISION = 4, 8
#: Frames that are packed or unpacked side by side.
LANES = 1024


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = np.zeros(256, np.int64), 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: leading zeros of a 16-bit number
ZEROS = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_many(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges side by side."""
    order = np.argsort(-size)
    at, left = start[order], size[order]
    live = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")  # ranges of at least i bytes
    c = np.zeros(len(start), np.int64)
    for i, n in enumerate(live.tolist()):
        c[:n] = CRC16[(c[:n] >> 8) ^ buf[at[:n] + i]] ^ (c[:n] << 8 & 0xFFFF)
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    parts = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        parts.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(parts)])


def _frame_header(number: int, size: int) -> bytes:
    code, extra = (0x7, struct.pack(">H", size - 1)) if size > 256 else (0x6, bytes([size - 1]))
    head = bytes([0xFF, 0xF8, code << 4 | 0x4, 0x00 | 0x1 << 1]) + _utf8_number(number) + extra
    return head + bytes([crc8(head)])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _header(number: int, size: int) -> bytes:
    key = (number, size)
    if key not in _HEADERS:
        if len(_HEADERS) > 50_000:
            _HEADERS.clear()
        _HEADERS[key] = _frame_header(number, size)
    return _HEADERS[key]


def _pack(values: np.ndarray, bits: np.ndarray, skip: np.ndarray, row_bytes: np.ndarray) -> list[bytes]:
    """Rows of numbers written one after the other, each `skip` zero bits and then `bits` bits (at most 32); rows padded to whole bytes."""
    n, m = values.shape
    total = bits + skip
    ends = np.cumsum(total, 1)
    start_bits = np.concatenate([[0], np.cumsum(row_bytes)[:-1]]) * 8
    last = (ends + start_bits[:, None] - 1).ravel()
    word, shift = last >> 5, 31 - (last & 31)
    v = values.astype(np.uint64).ravel() << shift.astype(np.uint64)
    out = np.zeros(int((row_bytes.sum() + 3) // 4) + 2, np.uint64)
    for part, w in ((v & np.uint64(0xFFFFFFFF), word), (v >> np.uint64(32), word - 1)):
        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        sums = np.add.reduceat(part, cut)
        at = w[cut]
        out[np.where(at < 0, len(out) - 1, at)] += sums
    raw = out[:-1].astype(">u4").tobytes()
    cuts = np.concatenate([[0], np.cumsum(row_bytes)])
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shifts) of linear predictors of rows of 8-bit samples: whole numbers, the latest sample first."""
    n, size = x.shape
    r = np.stack([(x[:, lag:] * x[:, : size - lag]).sum(1, dtype=np.int64) for lag in range(ORDER + 1)]).astype(np.float64)
    a, error = np.zeros((ORDER, n)), r[0].copy()
    for i in range(ORDER):
        k = r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)
        k = np.where(error > 0, k / np.where(error > 0, error, 1), 0)
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = error * (1 - k * k)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(0), 1e-9))), 0, 15).astype(np.int32)
    q = np.clip(np.rint(a * 2.0**shift), -top, top).astype(np.int32)
    return q.T, shift


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of rows of residuals as unsigned numbers."""
    mean = np.maximum(z.mean(1), 1e-9)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))).astype(np.int64), 0, 13)
    cost = np.stack([(z >> (k + e).clip(0, 14)[:, None]).sum(1, dtype=np.int64) + z.shape[1] * (1 + (k + e).clip(0, 14)) for e in (0, 1)])
    return cost.min(0), np.where(cost[1] < cost[0], k + 1, k).clip(0, 14)


def _subframes(x: np.ndarray) -> list[bytes]:
    """Subframes of rows of 8-bit samples."""
    n, size = x.shape
    d1 = np.diff(x, axis=1)
    choices = []
    for order, r in ((0, x), (1, d1), (2, np.diff(d1, axis=1))):
        if size <= order:
            break
        z = (r << 1) ^ (r >> 31)
        cost, k = _rice(z)
        choices.append((8 + 8 * order + 6 + 4 + cost, k, z))
    n_fixed = len(choices)
    if size > 4 * ORDER:
        coefs, shift = _predictors(x)
        guess = sum(coefs[:, j, None] * x[:, ORDER - 1 - j : size - 1 - j] for j in range(ORDER)) >> shift[:, None]
        r = x[:, ORDER:] - guess
        z = (r << 1) ^ (r >> 31)
        cost, k = _rice(z)
        choices.append((8 + 8 * ORDER + 4 + 5 + PRECISION * ORDER + 6 + 4 + cost, k, z))
    best = np.argmin(np.stack([c[0] for c in choices]), 0)
    bits = np.stack([c[0] for c in choices])[best, np.arange(n)]
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (bits >= 8 + 8 * size)
    out: list[bytes] = [b""] * n
    raw = x.astype(np.int8)
    for i in np.flatnonzero(constant).tolist():
        out[i] = b"\x00" + raw[i, :1].tobytes()
    for i in np.flatnonzero(verbatim).tolist():
        out[i] = b"\x02" + raw[i].tobytes()
    for c, (_, k, z) in enumerate(choices):
        rows = np.flatnonzero((best == c) & ~constant & ~verbatim)
        if not len(rows):
            continue
        linear = c == n_fixed
        order = ORDER if linear else c
        k, z = k[rows], z[rows]
        # (number, bits) of what stands before the residuals: type, warm-up samples, predictor, method and partition order, parameter
        lead = [((0x20 | order - 1) << 1 if linear else (0x08 | order) << 1, 8), *((x[rows, i] & 0xFF, 8) for i in range(order))]
        if linear:
            lead += [(PRECISION - 1, 4), (shift[rows], 5), *((coefs[rows, j] & (1 << PRECISION) - 1, PRECISION) for j in range(order))]
        lead += [(0, 6), (k, 4)]
        m = len(lead)
        v = np.empty((len(rows), m + z.shape[1]), np.int64)
        b, skip = np.empty_like(v), np.zeros_like(v)
        for j, (value, width) in enumerate(lead):
            v[:, j], b[:, j] = value, width
        v[:, m:] = (1 << k)[:, None] | z & ((1 << k) - 1)[:, None]
        b[:, m:], skip[:, m:] = (k + 1)[:, None], z >> k[:, None]
        size_bits = (b + skip).sum(1)
        for i, s in zip(rows.tolist(), _pack(v, b, skip, (size_bits + 7) // 8)):
            out[i] = s
    return out


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams (mono, 8 bits) of payloads whose bytes are samples offset by 128; lengths must be positive multiples of UNIT."""
    where: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        if not p or len(p) % UNIT:
            raise ValueError("a payload's length must be a positive multiple of 64")
        for j in range(0, len(p), BLOCK):
            where.setdefault(min(BLOCK, len(p) - j), []).append((i, j))
    frames: list[list[bytes]] = [[b""] * (-(-len(p) // BLOCK)) for p in payloads]
    for size, places in where.items():
        for a in range(0, len(places), LANES):
            part = places[a : a + LANES]
            x = np.frombuffer(b"".join(payloads[i][j : j + size] for i, j in part), np.uint8).reshape(len(part), size).astype(np.int32) - 128
            for (i, j), sub in zip(part, _subframes(x)):
                frames[i][j // BLOCK] = _header(j // BLOCK, size) + sub
    flat = [f for own in frames for f in own]
    sizes = np.array([len(f) for f in flat])
    buf = np.frombuffer(b"".join(flat), np.uint8)
    crcs = iter(crc16_many(buf, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes).tolist())
    out = []
    for p, own in zip(payloads, frames):
        own = [f + next(crcs).to_bytes(2, "big") for f in own]
        lens = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek, at = [], 0
        for j, n in enumerate(lens):
            seek.append(struct.pack(">QQH", j * BLOCK, at, min(BLOCK, len(p) - j * BLOCK)))
            at += n
        points = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


class Info:
    """STREAMINFO, where the frames begin, and the frame offsets of a seek table with an entry for each frame, if there is one."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        self.total = None
        while not last:
            if at + 4 > len(data):
                raise ValueError("the metadata is cut off")
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            last, body = bool(kind & 0x80), data[at + 4 : at + 4 + size]
            if kind & 0x7F == 0:
                x = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.total = x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1
                self.md5 = body[18:34]
                self.block = struct.unpack(">H", body[2:4])[0]
            elif kind & 0x7F == 3:
                self.points = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
            at += 4 + size
        if self.total is None:
            raise ValueError("no STREAMINFO")
        self.first = at


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_RATE_EXTRA = {12: 1, 13: 2, 14: 2}


def frame_header(data: bytes, at: int, info: Info) -> tuple[int, int, int, int, int] | None:
    """(number or first sample, samples, channel code, bits, length of the header), or None if no header is there."""
    h = data[at : at + 17]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] & 1:
        return None
    size, rate, channels, bits = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    if size == 0 or rate == 15 or channels > 10 or bits == 3:
        return None
    lead = h[4]
    n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if n > 7 or lead & 0xC0 == 0x80 or len(h) < 5 + n:
        return None
    number = lead if n == 1 else lead & (0x7F >> n)
    for b in h[5 : 4 + n]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    p = 4 + n
    if size in (6, 7):
        samples = int.from_bytes(h[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        samples = _SIZES[size]
    p += _RATE_EXTRA.get(rate, 0)
    if p >= len(h) or crc8(h[:p]) != h[p]:
        return None
    return number, samples, channels, _BITS.get(bits, info.bits), p + 1


def find_frames(data: bytes, info: Info) -> list[tuple[int, int, tuple]]:
    """(start, end, header) of each frame, by the seek table if it has them all, else by sync codes; a frame ends where the next header begins and its CRC-16 fits."""
    out: list[tuple[int, int, tuple]] = []
    if info.points:
        starts = [info.first + o for _, o, _ in info.points]
        heads = [frame_header(data, s, info) for s in starts]
        if all(heads) and sum(h[1] for h in heads) == info.total and starts[0] == info.first:
            return list(zip(starts, [*starts[1:], len(data)], heads))
    at = info.first
    while at < len(data):
        head = frame_header(data, at, info)
        if head is None:
            raise ValueError(f"no frame header at byte {at}")
        nxt = at + head[4]
        while True:
            nxt = data.find(b"\xff", nxt + 1)
            if nxt < 0:
                nxt = len(data)
                break
            follow = frame_header(data, nxt, info)
            if follow and follow[0] in (head[0] + 1, head[0] + head[1]):
                body = np.frombuffer(data, np.uint8, nxt - at, at)
                if crc16_many(body, np.array([0]), np.array([len(body)]))[0] == 0:
                    break
        out.append((at, nxt, head))
        at = nxt
    return out


class _Bits:
    """Bit positions in a shared buffer, one per lane."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(buf) + 8
        self.words = b[:n] << np.uint64(40) | b[1 : n + 1] << np.uint64(32) | b[2 : n + 2] << np.uint64(24) | b[3 : n + 3] << np.uint64(16) | b[4 : n + 4] << np.uint64(8) | b[5 : n + 5]

    def peek(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits (at most 40) from each position."""
        w = self.words[pos >> 3].view(np.int64)
        return w >> (48 - (pos & 7) - n) & ((np.int64(1) << n) - 1)

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one, from each position."""
        q = ZEROS[self.peek(pos, 16)]
        more = np.flatnonzero(q == 16)
        while len(more):
            z = ZEROS[self.peek(pos[more] + q[more], 16)]
            q[more] += z
            more = more[z == 16]
            if len(more) and (pos[more] + q[more] > 8 * len(self.words)).any():
                raise ValueError("a residual runs past the end")
        return q


def _signed(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (bits - 1) & 1) << bits)


def _residuals(bits: _Bits, pos: np.ndarray, size: np.ndarray, order: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Decodes the Rice residuals of all lanes side by side into out[rows, order:size]; returns the new positions."""
    method = bits.peek(pos, np.int64(2))
    if (method > 1).any():
        raise ValueError("unknown residual method")
    wide = np.where(method == 1, 5, 4)
    parts = np.int64(1) << bits.peek(pos + 2, np.int64(4))
    pos = pos + 6
    per = size // parts
    rank = np.argsort(-size, kind="stable")
    lanes = {name: a[rank] for name, a in (("pos", pos), ("size", size), ("order", order), ("wide", wide), ("per", per), ("rows", rows))}
    pos, size, order, wide, per, rows = lanes.values()
    k, raw = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    few_parts = per.min() if len(per) else 1
    fresh = np.zeros(len(pos), bool)
    fresh[:] = True
    boundary = np.unique(per)
    any_raw = False
    start = int(order.min()) if len(order) else 0
    for i in range(start, len(live)):
        n = live[i]
        p = pos[:n]
        due = None
        if i == start or i <= order.max() or any(i % int(b) == 0 for b in boundary):
            due = np.flatnonzero(((i == order[:n]) | ((i % per[:n] == 0) & (i > order[:n]))))
            if len(due):
                w = wide[due]
                k[due] = bits.peek(p[due], w)
                p[due] += w
                esc = k[due] == (1 << w) - 1
                raw[due] = 0
                if esc.any():
                    e = due[esc]
                    raw[e] = 1 + bits.peek(p[e], np.int64(5))
                    p[e] += 5
                    any_raw = True
        go = order[:n] <= i
        if go.all() and not any_raw:
            q = bits.unary(p)
            kk = k[:n]
            p += q + 1
            z = q << kk | bits.peek(p, kk)
            p += kk
            out[rows[:n], i] = (z >> 1) ^ -(z & 1)
        else:
            a = np.flatnonzero(go & (raw[:n] == 0))
            if len(a):
                q = bits.unary(p[a])
                p[a] += q + 1
                z = q << k[a] | bits.peek(p[a], k[a])
                p[a] += k[a]
                out[rows[a], i] = (z >> 1) ^ -(z & 1)
            a = np.flatnonzero(go & (raw[:n] > 0))
            if len(a):
                w = raw[a] - 1
                v = bits.peek(p[a], w)
                out[rows[a], i] = np.where(w > 0, _signed(v, np.maximum(w, 1)), 0)
                p[a] += w
    back = np.empty_like(pos)
    back[rank] = pos
    return back


def _subframe(bits: _Bits, pos: np.ndarray, size: np.ndarray, depth: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decodes one subframe of each lane into the rows of out; returns the new positions."""
    head = bits.peek(pos, np.int64(8))
    if (head & 0x80).any():
        raise ValueError("a subframe doesn't begin with a zero bit")
    kind = head >> 1 & 0x3F
    pos = pos + 8
    wasted = np.zeros(len(pos), np.int64)
    w = np.flatnonzero(head & 1)
    if len(w):
        wasted[w] = bits.unary(pos[w]) + 1
        pos[w] += wasted[w]
    depth = depth - wasted
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("reserved subframe type")
    a = np.flatnonzero(constant)
    if len(a):
        out[a] = _signed(bits.peek(pos[a], depth[a]), depth[a])[:, None]
        pos[a] += depth[a]
    a = np.flatnonzero(verbatim)
    for i in range(int(size[a].max()) if len(a) else 0):
        b = a[size[a] > i]
        out[b, i] = _signed(bits.peek(pos[b], depth[b]), depth[b])
        pos[b] += depth[b]
    a = np.flatnonzero(fixed | linear)
    if len(a):
        order = np.where(fixed[a], kind[a] - 8, kind[a] - 31)
        for i in range(int(order.max())):
            on = order > i
            b = a[on]
            out[b, i] = _signed(bits.peek(pos[b], depth[b]), depth[b])
            pos[b] += depth[b]
        coefs, shift = np.zeros((len(a), 32), np.int64), np.zeros(len(a), np.int64)
        lin = np.flatnonzero(linear[a])
        if len(lin):
            b = a[lin]
            precision = bits.peek(pos[b], np.int64(4)) + 1
            shift[lin] = _signed(bits.peek(pos[b] + 4, np.int64(5)), 5)
            if (precision == 16).any() or (shift < 0).any():
                raise ValueError("invalid predictor")
            pos[b] += 9
            for i in range(int(order[lin].max())):
                on = order[lin] > i
                c = lin[on]
                coefs[c, i] = _signed(bits.peek(pos[a[c]], precision[on]), precision[on])
                pos[a[c]] += precision[on]
        pos[a] = _residuals(bits, pos[a], size[a], order, out, a)
        # fixed predictors of order m: the samples are m-fold sums of differences, warm-up samples turned into differences first
        for m in range(1, 5):
            f = a[fixed[a] & (order == m)]
            if len(f):
                x = out[f]
                for j in range(m):  # differences of the warm-up, of order j at place j
                    x[:, j + 1 : m] = x[:, j + 1 : m] - x[:, j : m - 1]
                for j in range(m - 1, -1, -1):
                    x[:, j:] = np.cumsum(x[:, j:], 1)
                out[f] = x
        if len(lin):
            b, o = a[lin], order[lin]
            most = int(o.max())
            x, c, by = np.ascontiguousarray(out[b].T), np.ascontiguousarray(coefs[lin, :most].T), shift[lin]
            for i in range(int(o.min()), int(size[b].max())):
                past = x[max(0, i - most) : i][::-1]
                guess = (c[: len(past)] * past).sum(0) >> by
                x[i] += guess if i >= most else np.where(o <= i, guess, 0)
            out[b] = x.T
    w = np.flatnonzero(wasted)
    if len(w):
        out[w] <<= wasted[w, None]
    return pos


def _unpack(buf: np.ndarray, frames: list[tuple[int, int, tuple]]) -> list[np.ndarray]:
    """Samples (channels, n) of frames (start, length, header) of a buffer, decoded side by side; checksums are verified."""
    start, length = np.array([f[0] for f in frames], np.int64), np.array([f[1] for f in frames], np.int64)
    if (crc16_many(buf, start, length) != 0).any():
        raise ValueError("a frame's checksum doesn't fit")
    bits = _Bits(buf)
    decoded: list[np.ndarray | None] = [None] * len(frames)
    for code in {f[2][2] for f in frames}:
        own = np.array([i for i, f in enumerate(frames) if f[2][2] == code])
        size = np.array([frames[i][2][1] for i in own], np.int64)
        depth = np.array([frames[i][2][3] for i in own], np.int64)
        pos = (start[own] + np.array([frames[i][2][4] for i in own])) * 8
        channels = code + 1 if code < 8 else 2
        outs = []
        for c in range(channels):
            out = np.zeros((len(own), int(size.max())), np.int64)
            side = (code == 8 and c == 1) or (code == 9 and c == 0) or (code == 10 and c == 1)
            pos = _subframe(bits, pos, size, depth + side, out)
            outs.append(out)
        if ((pos + 7) // 8 + 2 != start[own] + length[own]).any():
            raise ValueError("a frame's length doesn't fit")
        if code == 8:
            outs[1] = outs[0] - outs[1]
        elif code == 9:
            outs[0] = outs[0] + outs[1]
        elif code == 10:
            mid = outs[0] << 1 | outs[1] & 1
            outs = [(mid + outs[1]) >> 1, (mid - outs[1]) >> 1]
        for j, i in enumerate(own.tolist()):
            decoded[i] = np.stack([o[j, : size[j]] for o in outs])
    return decoded


def decode_blocks(streams: list[bytes]) -> Iterator[tuple[int, Info, int, np.ndarray | None]]:
    """(stream, info, first sample, samples by channel) of each frame, stream after stream, LANES frames unpacked at a time; None for the samples when a stream ends, at the number of its samples, which have been checked with its MD5."""
    infos, frames, base = [], [], 0
    for i, s in enumerate(streams):
        infos.append(Info(s))
        frames += [(i, base + a, b - a, h) for a, b, h in find_frames(s, infos[-1])]
        base += len(s)
    buf = np.frombuffer(streams[0] if len(streams) == 1 else b"".join(streams), np.uint8)
    now, at, digest = 0, 0, hashlib.md5()

    def end() -> tuple[int, Info, int, None]:
        info = infos[now]
        if info.total and at != info.total:
            raise ValueError("the number of samples doesn't fit")
        if info.md5 != bytes(16) and digest.digest() != info.md5:
            raise ValueError("the samples' MD5 doesn't fit")
        return now, info, at, None

    for a in range(0, len(frames), LANES):
        part = frames[a : a + LANES]
        lo, hi = part[0][1], part[-1][1] + part[-1][2]
        for (i, *_), x in zip(part, _unpack(buf[lo:hi], [(f[1] - lo, f[2], f[3]) for f in part])):
            while now < i:
                yield end()
                now, at, digest = now + 1, 0, hashlib.md5()
            digest.update(pcm(x, infos[i].bits))
            yield i, infos[i], at, x
            at += x.shape[1]
    while now < len(streams):
        yield end()
        now, at, digest = now + 1, 0, hashlib.md5()


def decode_many(streams: list[bytes]) -> list[tuple[Info, np.ndarray]]:
    """(info, samples by channel) of each stream as a whole."""
    result, own = [], []
    for _, info, _, x in decode_blocks(streams):
        if x is not None:
            own.append(x)
            continue
        result.append((info, np.concatenate(own, 1) if own else np.zeros((info.channels, 0), np.int64)))
        own = []
    return result


def read_samples(stream: bytes, first: int, n: int) -> np.ndarray:
    """Samples (channels, n) from number `first` on: only the frames in which they lie are decoded, found by the seek table if there is one."""
    info = Info(stream)
    at, out = 0, []
    own = []
    if info.points and all(p[0] != (1 << 64) - 1 for p in info.points):
        i = max(0, bisect_right([p[0] for p in info.points], first) - 1)
        for j in range(i, len(info.points)):
            number, offset, _ = info.points[j]
            if number >= first + n:
                break
            end = info.first + info.points[j + 1][1] if j + 1 < len(info.points) else len(stream)
            head = frame_header(stream, info.first + offset, info)
            if head is None:
                raise ValueError("the seek table names no frame")
            own.append((number, info.first + offset, end - info.first - offset, head))
    else:
        for a, b, head in find_frames(stream, info):
            if at < first + n and at + head[1] > first:
                own.append((at, a, b - a, head))
            at += head[1]
    for a in range(0, len(own), LANES):
        part = own[a : a + LANES]
        lo, hi = part[0][1], part[-1][1] + part[-1][2]
        out += _unpack(np.frombuffer(stream, np.uint8)[lo:hi], [(f[1] - lo, f[2], f[3]) for f in part])
    if not out:
        return np.zeros((info.channels, 0), np.int64)
    return np.concatenate(out, 1)[:, max(0, first - own[0][0]) : max(0, first + n - own[0][0])]


class PcmBlocks:
    """Blocks of interleaved PCM bytes in order, with the numbers of their first samples."""

    def __init__(self, frame_bytes: int):
        self.width, self.first, self.blocks, self.n = frame_bytes, [], [], 0

    def add(self, data: bytes) -> None:
        self.first.append(self.n)
        self.blocks.append(data)
        self.n += len(data) // self.width

    def read(self, first: int, n: int) -> bytes:
        """The bytes of n samples from number `first` on; only the blocks in which they lie are touched."""
        i, out = max(0, bisect_right(self.first, first) - 1), []
        while i < len(self.blocks) and self.first[i] < first + n:
            a = max(0, first - self.first[i])
            out.append(self.blocks[i][a * self.width : (first + n - self.first[i]) * self.width])
            i += 1
        return b"".join(out)


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples of whole bytes."""
    flat = np.ascontiguousarray(samples.T).ravel()
    width = (bits + 7) // 8
    if width == 1:
        return flat.astype(np.int8).tobytes()
    if width == 3:
        return np.ascontiguousarray(flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return flat.astype("<i2" if width == 2 else "<i4").tobytes()


class Features:
    """Level, zero crossings and roughness of one channel, block by block, as integers so that equal samples give equal strings."""

    def __init__(self):
        self.n = self.sum = self.power = self.peak = self.cross = self.rough = 0
        self.last: np.ndarray | None = None

    def add(self, x: np.ndarray) -> None:
        self.n, self.sum, self.power = self.n + len(x), self.sum + int(x.sum()), self.power + int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        if self.last is not None:
            x = np.concatenate([self.last, x])
        self.cross += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        self.rough += int(np.abs(np.diff(x)).sum())
        self.last = x[-1:]

    def __str__(self) -> str:
        n = self.n
        return f"n={n};mean={self.sum * 1000 // n};power={self.power * 1000 // n};peak={self.peak};zcr={self.cross * 1_000_000 // n};tv={self.rough * 1000 // n}"


def payload_of(text: bytes) -> bytes:
    return text + bytes(UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text's payload as a FLAC stream, reads it back and describes both; the stream itself if wanted."""
    ship(df.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                raw = buf.tobytes()
                sizes = np.diff(off)
                media = encode_many([payload_of(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
                out, blocks, digest, feature = [], PcmBlocks(1), hashlib.sha256(), Features()
                for i, _, total, x in decode_blocks(media):
                    if x is not None:
                        back = (x[0] + 128).astype(np.uint8).tobytes()
                        digest.update(back)
                        feature.add(x[0])
                        blocks.add(back)
                        continue
                    tail = blocks.read(total - UNIT, UNIT)
                    out.append((int(sizes[i]), total, digest.hexdigest(), zlib.crc32(tail), len(media[i]), hashlib.sha256(media[i]).hexdigest(), str(feature)))
                    blocks, digest, feature = PcmBlocks(1), hashlib.sha256(), Features()
                cols = [pa.array([o[k] for o in out], pa.string() if k in (2, 5, 6) else pa.int64()) for k in range(7)]
                yield pa.RecordBatch.from_arrays([tc.id_array(rows, id_col), *cols, *[pa.array(media, pa.binary())] * with_media], [id_col, *names, *["media"] * with_media])

    kinds = [T.StringType() if n.endswith(("sha256", "feature")) else T.LongType() for n in names]
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, k) for n, k in zip(names, kinds)), *[T.StructField("media", T.BinaryType())] * with_media])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def write_pcm_blocks(df: DataFrame, id_col: str, media_col: str, samples: int = BLOCK) -> DataFrame:
    """(id, block, first_sample, n_samples, rate, channels, bits, pcm): blocks of decoded samples; block b begins at sample b * samples."""
    ship(df.sparkSession)
    names = ["block", "first_sample", "n_samples", "rate", "channels", "bits", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(1).to_pylist()
            for at in range(0, len(streams), 64):
                there = [i for i in range(at, min(at + 64, len(streams))) if streams[i] is not None]
                rows, blocks = [], None
                for k, info, total, x in decode_blocks([streams[i] for i in there]):
                    width = info.channels * ((info.bits + 7) // 8)
                    blocks = blocks or PcmBlocks(width)
                    if x is not None:
                        blocks.add(pcm(x, info.bits))
                        continue
                    for j, a in enumerate(range(0, total, samples)):
                        part = blocks.read(a, samples)
                        rows.append((there[k], j, a, len(part) // width, info.rate, info.channels, info.bits, part))
                    blocks = None
                if rows:
                    cols = [pa.array([r[k] for r in rows], pa.binary() if k == 7 else pa.int64()) for k in range(1, 8)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows])), *cols], [id_col, *names])

    schema = T.StructType([df.schema[id_col], *(T.StructField(n, T.BinaryType() if n == "pcm" else T.LongType()) for n in names)])
    return df.select(id_col, F.col(media_col).cast("binary").alias("_media")).mapInArrow(run, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


QUERIES = {"op6_media": op6_media}
ORACLES: dict[str, str] = {}
