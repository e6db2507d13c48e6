"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point; an n-gram of letters is the product of its letters' vectors, each
permuted (rotated) by its place; a text is the sum of its n-gram vectors; a language is the sum of the unit
vectors of its texts. A text is given the language whose vector it has the largest cosine with; ties go to the
first language by code point. score = (1 + cosine) / 2.

Letters are Unicode letters, lower-cased; anything else parts words. Each text's n-grams are counted first, so
that every distinct one is looked up once. Learning sums integers (unit vectors times 2**20), so the order of
tasks doesn't matter; partial sums are added within batches, then by language and block of dimensions. A text's vector
and the prototypes (16 bits a dimension) are whole numbers and their products are exact, so scores don't depend
on how rows are laid out.

Up to MAX_LANGUAGES languages the prototypes go to the driver and back to the tasks (languages x DIM numbers).
Beyond, they stay a table, and vectors of texts meet blocks of languages in a join by block; the result is the same.

Nulls: a null text, or one without letters, is "und" with score 0 and teaches nothing; a row with null language
teaches nothing; if no row teaches, all are "und". Empty tables: no rows. Repeated rows count each time. Further
columns are ignored; language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.common import materialize, ship, table
from quirefold.llm import textcore as tc

DIM, UNIT, MAX_LANGUAGES = 512, 1 << 20, 5_000
#: Largest number in a prototype: with texts of up to 2**28 n-grams, products over DIM dimensions stay below 2**53.
PEAK = (1 << 15) - 1
GAP = 0  # between words


@lru_cache(1)
def lower_letters() -> np.ndarray:
    """Code point -> that of the letter in lower case, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Vectors of letters (code points), drawn from hashes of the code point; GAP has one too."""
    blocks = np.arange(1, DIM // 64 + 1, dtype=np.uint64)
    words = tc.mix(tc.mix(letters.astype(np.uint64) + tc.U64(0x51ED270B))[:, None] + blocks[None, :] * tc.U64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their first bytes) of valid UTF-8; stray bytes come out as no letters."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.uint32)
    x = b[lead]
    n = 1 + (x >= 0xC0) + (x >= 0xE0) + (x >= 0xF0)
    c = np.where(n == 1, x, x & (0xFF >> (n + 1)))
    for j in range(1, 4):
        c = np.where(n > j, (c << 6) | (b[lead + j] & 0x3F), c)
    return np.minimum(c, 0x10FFFF), lead


def vectors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a vector for each text, whether it has a letter)."""
    points, lead = code_points(buf)
    code = lower_letters()[points]
    cut = np.searchsorted(lead, off)
    n = len(off) - 1
    has = np.add.reduceat(np.append(code > 0, False), cut[:-1]) > 0 if n else np.zeros(0, bool)
    has &= cut[1:] > cut[:-1]
    # a gap before the first and after the last letter of each text, and one only between words
    doc = np.repeat(np.arange(n), np.diff(cut))
    keep = code > 0
    keep[1:] |= (code[:-1] > 0) & (doc[1:] == doc[:-1])
    code, doc = code[keep], doc[keep]
    starts = np.searchsorted(doc, np.arange(n))
    code, doc = np.insert(code, starts, GAP), np.insert(doc, starts, np.arange(n))
    ends = np.searchsorted(doc, np.arange(n), "right")
    code, doc = np.insert(code, ends, GAP), np.insert(doc, ends, np.arange(n))
    inside = (doc[2:] == doc[:-2]) & (code[1:-1] > 0)
    letters, code = np.unique(code, return_inverse=True)
    m = len(letters)
    grams, where = np.unique(((code[:-2] * m + code[1:-1]) * m + code[2:])[inside], return_inverse=True)
    keys, counts = np.unique(doc[:-2][inside] * len(grams) + where, return_counts=True)
    d, where = np.divmod(keys, max(1, len(grams)))
    v = letter_vectors(letters)
    table_ = (np.roll(v, 2, 1)[grams // (m * m)] * np.roll(v, 1, 1)[grams // m % m] * v[grams % m]).astype(np.float32)
    out = np.zeros((n, DIM))
    at = np.searchsorted(d, np.arange(n + 1))
    for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
        a, b = at[i], at[i + 1]
        own = counts[a:b]
        out[i] = own.astype(np.float32 if own.sum() < 1 << 24 else np.float64) @ table_[where[a:b]]  # sums of whole numbers, exact in any order
    return out, has


def _units(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    return v / np.where(norm > 0, norm, 1)[:, None]


def _whole(sums: np.ndarray) -> np.ndarray:
    """Prototypes as whole numbers of up to PEAK."""
    top = np.abs(sums).max(1, initial=0)
    return np.rint(sums / np.where(top > 0, top, 1)[:, None] * PEAK).astype(np.int16)


def _cosines(v: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    p = prototypes.astype(np.float64)
    size = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((p * p).sum(1))[None, :]
    return (v @ p.T) / np.where(size > 0, size, 1)


BLOCKS = 8


def _sums(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, block, x): sums of the unit vectors of each language's texts, in blocks of dimensions, from all rows with a text of letters and a language."""
    ship(df.sparkSession)
    blocks = BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for rows, buf, off in tc.slices(batch, "text"):
                v, has = vectors(buf, off)
                q = np.rint(_units(v) * UNIT).astype(np.int64)
                langs = rows.column(1).dictionary_encode()
                codes = langs.indices.to_numpy(zero_copy_only=False)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    s = q[(codes == i) & has]
                    if len(s):
                        sums[lang] = sums.get(lang, 0) + s.sum(0)
            if sums:
                keys = [(k, j) for k in sums for j in range(blocks)]
                parts = np.concatenate([s.reshape(blocks, -1) for s in sums.values()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([j for _, j in keys], pa.int32()), lists], ["lang", "block", "sums"])

    part = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = part.mapInArrow(run, "lang string, block int, sums array<long>")
    flat = rows.select("lang", "block", F.posexplode("sums").alias("i", "x")).groupBy("lang", "block", "i").agg(F.sum("x").alias("x"))
    return flat.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("lang", "block", "s.x")


def _prototypes(rows: list) -> tuple[list[str], np.ndarray]:
    langs = sorted({r["lang"] for r in rows})
    number = {k: i for i, k in enumerate(langs)}
    out = np.zeros((len(langs), BLOCKS, DIM // BLOCKS))
    for r in rows:
        out[number[r["lang"]], r["block"]] = r["x"]
    return langs, _whole(out.reshape(len(langs), DIM))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes), for at most MAX_LANGUAGES; beyond, it raises an error, and identify is the way."""
    got = _sums(df, text_col, lang_col).limit(BLOCKS * MAX_LANGUAGES + 1).collect()
    if len(got) > BLOCKS * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return _prototypes(got)


def identify(taught: DataFrame, df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """predict() for df by what learn() has from `taught`, for any number of languages."""
    sums = materialize(_sums(taught, text_col, lang_col), "language-sums")
    if sums.filter("block = 0").limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES:
        return predict(df, *_prototypes(sums.collect()), text_col, keep)
    return _predict_in_blocks(df, sums, text_col, keep)


def _predict_in_blocks(df: DataFrame, sums: DataFrame, text_col: str, keep: dict[str, Column] | None) -> DataFrame:
    """As predict, with prototypes as a table: texts' vectors and languages meet in cells of a chunk of texts and a block of languages."""
    ship(df.sparkSession)
    keep = keep or {"doc_id": F.col("doc_id")}
    n_blocks = sums.filter("block = 0").count() // MAX_LANGUAGES + 1
    rows = df.select(F.struct(*(c.alias(k) for k, c in keep.items())).alias("kept"), F.col(text_col).alias("_text")).withColumn("row", F.monotonically_increasing_id())

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in tc.slices(batch, "_text"):
                v, has = vectors(buf, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(has), lists], ["kept", "row", "has", "v"])

    out = T.StructType([rows.schema["kept"], T.StructField("row", T.LongType()), T.StructField("has", T.BooleanType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    texts = materialize(rows.mapInArrow(vector, out), "text-vectors")
    n_chunks = texts.filter("has").count() // 20_000 + 1
    chunk, block = F.pmod(F.xxhash64("row"), F.lit(n_chunks)), F.pmod(F.xxhash64("lang"), F.lit(n_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = texts.filter("has").select("row", "v", chunk.alias("chunk"), every(n_blocks).alias("language_block"))
    right = sums.select("lang", "block", "x", every(n_chunks).alias("chunk"), block.alias("language_block"))

    def best(texts: pa.Table, sums: pa.Table) -> pa.Table:
        langs, protos = _prototypes(sums.to_pylist())
        if not langs or not len(texts):
            return pa.table({"row": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
        v = np.concatenate([c.flatten().to_numpy() for c in texts.column("v").chunks]).reshape(-1, DIM)
        cos = _cosines(v, protos)
        return pa.table({"row": texts.column("row"), "lang": pa.array([langs[i] for i in cos.argmax(1)], pa.string()), "cos": pa.array(cos.max(1))})

    met = left.groupBy("chunk", "language_block").cogroup(right.groupBy("chunk", "language_block")).applyInArrow(best, "row long, lang string, cos double")
    top = met.groupBy("row").agg(F.min_by("lang", F.struct((-F.col("cos")).alias("c"), "lang")).alias("lang_pred"), F.max("cos").alias("cos"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + F.col("cos")) / 2))
    return texts.join(top, "row", "left").select(*(F.col(f"kept.{k}").alias(k) for k in keep), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("cos").isNotNull(), score).otherwise(0.0).alias("score"))


def predict(df: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns `keep` of each row of df, lang_pred and score."""
    ship(df.sparkSession)
    keep = keep or {"doc_id": F.col("doc_id")}
    chosen = df.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("_text"))
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for rows, buf, off in tc.slices(batch, "_text"):
                v, has = vectors(buf, off)
                best, score = np.full(len(has), len(langs)), np.zeros(len(has))
                if langs:
                    cos = _cosines(v, prototypes)
                    best = np.where(has, cos.argmax(1), best)
                    score = np.where(has, np.clip((1 + cos.max(1)) / 2, 0, 1), 0)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs.filter(~held), docs, keep={"doc_id": F.col("doc_id"), "held_out": held}).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
