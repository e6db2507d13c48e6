"""Byte-level BPE encoding and decoding by backtracking over dictionary matches.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton (pyahocorasick) finds all dictionary tokens in a
piece of text. The encoder takes the longest token at each place and goes back to shorter ones when the token
and its predecessor could not stand side by side: a pair may stand if merging its joined bytes by rank gives
that pair back, which is memoised. A place from which no encoding goes on is never tried again, so the work is
linear in the piece; the result is exactly that of merging by rank. Pieces come from the split pattern; short
pieces are memoised in a table that becomes the older of two when full.

One narrow pass, no shuffle. Nulls: a null text is an empty text (no ids); a null id of a row stays null. Bytes
that are not UTF-8 become U+FFFD before encoding. Empty table: no rows. Further columns are ignored by
encode_bpe and kept by with_tokens, which replaces columns of the names it adds.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quirefold.common import ship, table
from quirefold.llm import textcore as tc

#: Pieces in each of the two generations of the memo, pairs in theirs; longer pieces are not kept.
CACHED_PIECES, CACHED_PAIRS, CACHED_CHARS = 100_000, 100_000, 40

KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: KNOWN_PATTERN for code points below 256, its classes spelled out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def default_ranks() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.token_bytes = {i: b for b, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(LATIN_PATTERN).findall if pattern == KNOWN_PATTERN else None
        self.trie = ahocorasick.Automaton()
        #: token -> the two tokens whose merge makes it, last in merging its bytes; none for single bytes
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        usable = {b for b in self.ranks if len(b) == 1 or self.merge(b) == [self.ranks[b]]}
        for b in usable:
            self.trie.add_word(b.decode("latin-1"), len(b))
        self.trie.make_automaton()
        #: token -> the longest shorter token that it starts with
        self.shorter = {b: next((b[:k] for k in range(len(b) - 1, 0, -1) if b[:k] in usable), None) for b in usable}
        self.packed = {b: i.to_bytes(4, "little") for b, i in self.ranks.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merging by rank, step by step; for single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            i = best[1]
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._stands(a, b)
        return ok

    def _stands(self, a: bytes, b: bytes) -> bool:
        """Whether no merge crosses from a to b before both are whole: undo their merges from the latest on and look at the parts that then touch."""
        ranks, halves, before = self.ranks, self.halves, 1 << 60
        while True:
            if ranks.get(a + b, 1 << 60) < before:
                return False
            x, y = halves.get(a), halves.get(b)
            if x and (not y or ranks[a] > ranks[b]):
                before, a = ranks[a], x[1]
            elif y:
                before, b = ranks[b] + 1, y[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of a piece, four bytes each."""
        n = len(piece)
        if n == 1:
            return self.packed[piece]
        longest = [1] * n
        for end, k in self.trie.iter(piece.decode("latin-1")):
            if longest[end + 1 - k] < k:
                longest[end + 1 - k] = k
        if longest[0] == n:
            return self.packed[piece]
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[bytes] = [piece[: longest[0]]]
        known, shorter = self.pairs.get, self.shorter
        pos = longest[0]
        token = piece[pos : pos + longest[pos]]
        while True:
            end = pos + len(token)
            if open_at[end]:
                if out:
                    ok = known((out[-1], token))
                    if ok is None:
                        ok = self.stands(out[-1], token)
                else:
                    ok = True
                if ok:
                    out.append(token)
                    pos = end
                    if pos == n:
                        return b"".join([self.packed[t] for t in out])
                    token = piece[pos : pos + longest[pos]]
                    continue
            token = shorter[token]
            while token is None:
                open_at[pos] = 0
                last = out.pop()
                pos -= len(last)
                token = shorter[last]

    def split(self, text: str) -> list[str]:
        """The pieces of a text; texts of Latin-1 alone take a pattern of plain classes, where the one given is the known one."""
        if self.find_latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.find(text)
            return self.find_latin(text)
        return self.find(text)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        split = self.split(text)
        out = list(map(pieces.get, split))
        if None in out:
            if len(pieces) >= CACHED_PIECES:
                self.older, self.pieces = pieces, {}
                pieces = self.pieces
            at = -1
            for _ in range(out.count(None)):
                at = out.index(None, at + 1)
                s = split[at]
                ids = pieces.get(s)
                if ids is None:
                    ids = self.older.get(s) or self.encode_piece(s.encode())
                    if len(s) <= CACHED_CHARS:
                        pieces[s] = ids
                out[at] = ids
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def coder(path: str, pattern: str) -> Bpe:
    bpe = Bpe(path, pattern)
    gc.freeze()  # its tables are not looked at again
    return bpe


def _texts(buf: np.ndarray, off: np.ndarray) -> Iterator[str]:
    raw = buf.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield raw[a:b].decode("utf-8", "replace")


def encode_bpe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of df: id, n_tokens, SHA-256 of the ids and of the bytes decoded from them; the ids if wanted."""
    ship(df.sparkSession)
    if path is None or pattern is None:
        path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                ids = [bpe.encode_bytes(t) for t in _texts(buf, off)]
                cols = [tc.id_array(rows, id_col), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())]
                cols.append(pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string()))
                if with_ids:
                    cols.append(_lists(ids))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = [T.LongType(), T.StringType(), T.StringType(), *[T.ArrayType(T.IntegerType(), False)] * with_ids]
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def _lists(ids: list[bytes]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32)))


def with_tokens(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with n_tokens and ids (array of int) after its columns, of which the text can be left out, so that it needn't come back from Python; the ids are decoded and held against the text. Copies of a text that follow each other, as in a mix, are encoded once."""
    ship(df.sparkSession)
    if path is None or pattern is None:
        path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]
    df = df.drop("n_tokens", "ids")
    kept = [i for i, c in enumerate(df.schema.names) if keep_text or c != text_col]

    @tc.thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        last, x = "", b""
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                ids = []
                for t in _texts(buf, off):
                    if t != last:
                        last, x = t, bpe.encode_bytes(t)
                        if bpe.decode_bytes(x) != t.encode():
                            raise ValueError("decoding the ids doesn't give the text back")
                    ids.append(x)
                yield pa.RecordBatch.from_arrays([*map(rows.column, kept), pa.array([len(x) // 4 for x in ids], pa.int64()), _lists(ids)], [*(rows.schema.names[i] for i in kept), "n_tokens", "ids"])

    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with `decoded` (binary) from an array of ids; a null array gives null, an unknown id fails."""
    ship(df.sparkSession)
    path, pattern = path or default_ranks()[0], default_ranks()[1]
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for rows in batches:
            lists = rows.column(rows.schema.get_field_index(ids_col)).to_pylist()
            out = [None if x is None else b"".join(bpe.token_bytes[i] for i in x) for x in lists]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bpe(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLES: dict[str, str] = {}
