"""Quality rules: characters inside repeated n-grams and repeated lines, by rolling hashes in numpy.

One narrow pass: no shuffle, whole texts, memory bounded by the slice. A text is rejected by the base rule
(too few words, or too many words in 8-word windows that occur twice) or by the method's verdict: for some n
the later occurrences of repeated n-word runs, or the later occurrences of repeated lines, hold too many of
the characters in words.

Nulls: a null text is an empty text (no words, rejected); a null id stays null. Empty table: no rows. Repeated
rows: judged alike. Further columns of the input are ignored by quality_rules and kept by keep_quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quirefold.common import ship, table
from quirefold.llm import textcore as tc

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: n -> most percent of the characters in words that later occurrences of repeated n-grams may cover.
NGRAM_LIMITS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
LINE_LIMIT = 40
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "max_dup_ngram_chars"]


def _per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    out = np.zeros(len(keys), bool)
    at = np.flatnonzero(tc.repeated(keys))
    o = at[np.argsort(keys[at], kind="stable")]
    out[o[1:]] = keys[o[1:]] == keys[o[:-1]]
    return out


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by text."""
    n_docs = len(off) - 1
    w = tc.Words(buf, off)
    hasher = tc.Hasher(buf)
    doc = w.doc()
    chars = np.concatenate([[0], np.cumsum(w.inside & ((buf & 0xC0) != 0x80), dtype=np.int64)])
    word_chars = chars[off[1:]] - chars[off[:-1]]
    wc = chars[w.end] - chars[w.start]
    salt = tc.mix(np.arange(n_docs, dtype=np.uint64) + tc.U64(1))

    newline = np.flatnonzero(buf == 10)
    a = np.union1d(off[:-1], newline + 1)
    a = a[a < len(buf)]
    b = np.append(a[1:], len(buf))[: len(a)]
    b = np.where(buf[b - 1] == 10, b - 1, b)
    full = np.searchsorted(w.start, b) > np.searchsorted(w.start, a)
    a, b = a[full], b[full]
    line_doc = np.searchsorted(off, a, "right") - 1
    dup = _later(hasher.ranges(a, b) ^ salt[line_doc])
    n_dup_lines = np.bincount(line_doc[dup], minlength=n_docs)
    dup_line_chars = np.bincount(line_doc[dup], (chars[b] - chars[a])[dup], n_docs).astype(np.int64)

    h = hasher.ranges(w.start, w.end)
    worst = np.zeros(n_docs, np.int64)
    rejected = 100 * dup_line_chars > LINE_LIMIT * word_chars
    n_repeat = np.zeros(n_docs, np.int64)
    live = np.ones(len(h), bool)
    for n in sorted({*NGRAM_LIMITS, WINDOW}):
        m = len(h) - n + 1
        if m <= 0:
            break
        # a longer n-gram can only repeat where the shorter ones did
        at = np.flatnonzero((doc[n - 1 :] == doc[:m]) & live[:m])
        if not len(at):
            break
        g = np.zeros(len(at), tc.U64)
        for j in range(n):
            g += h[at + j] * tc.WORD_MULT[j]
        key = tc.mix(g) ^ salt[doc[at]]
        rep = tc.repeated(key)
        live = np.zeros(len(h), bool)
        live[at[rep]] = True
        if n == WINDOW:
            n_repeat = np.bincount(doc[tc.covered(at[rep], n, len(h))], minlength=n_docs)
        if n in NGRAM_LIMITS:
            again = at[rep][_later(key[rep])]
            cov = tc.covered(again, n, len(h))
            c = np.bincount(doc[cov], wc[cov], n_docs).astype(np.int64)
            worst = np.maximum(worst, c)
            rejected |= 100 * c > NGRAM_LIMITS[n] * word_chars
    base = (w.count < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * w.count)
    return {
        "n_words": w.count, "word_chars": word_chars, "n_symbols": _per_doc(SYMBOLS[buf], off), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat,
        "dup_line_chars": dup_line_chars, "max_dup_ngram_chars": worst, "base_failed": base, "kept": ~(base | rejected),
    }


def _rules(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                m = measure(buf, off)
                cols = [tc.id_array(rows, id_col)] + [pa.array(m[c].astype(np.int64)) for c in _COLUMNS] + [pa.array(m["base_failed"]), pa.array(m["kept"])]
                yield pa.RecordBatch.from_arrays(cols, [id_col, *_COLUMNS, "base_failed", "kept"])

    return run


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, the measures, base_failed and kept."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.LongType()) for c in _COLUMNS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    return df.select(id_col, text_col).mapInArrow(_rules(id_col, text_col), schema)


def keep_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose text the rules keep."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                yield rows.filter(pa.array(measure(buf, off)["kept"]))

    return df.mapInArrow(run, df.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    ngrams = ", ".join(f"({n}, {p})" for n, p in NGRAM_LIMITS.items())
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
    b AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM s),
    lines AS (SELECT doc_id, line, count(*) AS k, any_value(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS c
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
    dl AS (SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * c)::BIGINT AS dup_line_chars FROM lines GROUP BY 1),
    words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM b),
    ns(n, lim) AS (VALUES {ngrams}),
    grams AS (SELECT doc_id, n, i, list_aggregate(list_slice(w, i + 1, i + n), 'string_agg', ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM b, ns)),
    marked AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, g) AS k, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS r FROM grams),
    later AS (SELECT DISTINCT doc_id, n, i + j AS i FROM (SELECT doc_id, n, i, unnest(range(n)) AS j FROM marked WHERE r > 1)),
    lc AS (SELECT doc_id, n, sum(length(x))::BIGINT AS c FROM later JOIN words USING (doc_id, i) GROUP BY ALL),
    worst AS (SELECT doc_id, max(c) AS c, bool_or(100 * c > lim * word_chars) AS bad FROM lc JOIN ns USING (n) JOIN b USING (doc_id) GROUP BY 1),
    rep AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS c FROM (SELECT doc_id, i, unnest(range({WINDOW})) AS j FROM marked WHERE n = {WINDOW} AND k > 1) GROUP BY 1),
    m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words,
                 coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(worst.c, 0) AS max_dup_ngram_chars, coalesce(bad, false) AS bad
          FROM b LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN worst USING (doc_id)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, max_dup_ngram_chars, base_failed,
           NOT (base_failed OR bad OR 100 * dup_line_chars > {LINE_LIMIT} * word_chars) AS kept FROM f"""


QUERIES = {"op3_quality": op3_quality}
ORACLES = {"op3_quality": _oracle()}
