"""License scans by a positional index of licence words, weighted by their rarity.

First pass (narrow): the licence words of each text, with their positions, and the places of the base phrases.
The hits, without texts, are written to a table. From it the document frequency of every licence word over the
whole corpus gives its IDF. Second pass over that table: all licence words of a file are looked up in the template
postings; at each relative position (place in the file less place in the template) the words of the template that
stand there, SLACK words to either side, are summed by IDF. Where several words agree and the sum is a large enough
part of the template, the mandatory key phrases must stand there. So a file has the label of every template in it,
however many there are and however long it is. Words too common to be licence words (STOP) have no postings, but the
key phrases are compared word by word, those words too, in the first pass, which has the text: the place of each
whole phrase is a hit like those of words. Work and hits grow with the text alone, whatever repeats in it.

What is broadcast is the licence vocabulary, whose size is that of the templates. Nulls: a null text is empty (no
words, no places, labels ""); null ids are kept. Empty table: no rows. Repeated rows: each counts in the
document frequencies. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.common import materialize, ship, table
from quirefold.llm import textcore as tc

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label -> (template, mandatory key phrases in it)
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "associated documentation files")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("any purpose with or without fee is hereby granted",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("not use this file except in compliance with the license",)),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("you can redistribute it and or modify it", "gnu general public license")),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    "cc": ("this work is licensed under a creative commons attribution license", ("creative commons",)),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable for any damages arising from the use",)),
    "boost": ("distributed under the boost software license version 1 0", ("boost software license",)),
}
STOP = frozenset("a all and any are as at be can for form from has have in into is it may met no not of on or that the this to under use with without will you 0 1 2".split())
AGREE, SLACK, MIN_SCORE = 3, 2, 0.6
#: Hits whose template places are held at a time, but for a file that has more.
_HITS_AT_ONCE = 200_000


class Index:
    """Vocabulary, template postings and phrases; word ids are places in the sorted vocabulary."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [t for t, _ in templates.values()] + list(base)
        self.words = sorted({w for t in texts for w in t.split()} - STOP | {w for t in base for w in t.split()})
        self.id = {w: i for i, w in enumerate(self.words)}
        self.labels = list(templates)
        self.templates = [self._places(t) for t, _ in templates.values()]
        #: by template: (number of a key phrase, its place in the template); hits of phrase i have the id len(words) + i
        self.phrases: list[list[tuple[int, int]]] = []
        phrases: list[list[str]] = []
        for text, keys in templates.values():
            all_words = text.split()
            self.phrases.append([])
            for k in keys:
                phrase = k.split()
                at = next(i for i in range(len(all_words)) if all_words[i : i + len(phrase)] == phrase)
                self.phrases[-1].append((len(phrases), at))
                phrases.append(phrase)
        common = sorted({w for p in phrases for w in p} - set(self.words))  # looked up for the phrases only
        ids = self.id | {w: len(self.words) + i for i, w in enumerate(common)}
        self.keys = [[ids[w] for w in p] for p in phrases]
        self.base = [([self.id[w] for w in p.split()], label) for p, label in base.items()]
        raw = b" ".join(w.encode() for w in [*self.words, *common])
        buf = np.frombuffer(raw, np.uint8)
        w = tc.Words(buf, np.array([0, len(buf)]), tc.NOT_ALNUM)
        h = tc.Hasher(buf).ranges(w.start, w.end)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(h & tc.U64(0xFFFF)).astype(np.int64)] = True

    def _places(self, text: str) -> list[tuple[int, int]]:
        return [(i, self.id[w]) for i, w in enumerate(text.split()) if w in self.id]

    def find(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words by text, text of each hit, its word's number in the text, its id)."""
        low = tc.LOWER[buf]
        w = tc.Words(low, off, tc.NOT_ALNUM)
        h = tc.Hasher(low).ranges(w.start, w.end)
        at = np.flatnonzero(self.maybe[(h & tc.U64(0xFFFF)).astype(np.int64)])
        i = np.searchsorted(self.hashes, h[at])
        i[i == len(self.hashes)] = 0
        ok = self.hashes[i] == h[at]
        at, ids = at[ok], self.order[i[ok]]
        doc = np.searchsorted(w.first, at, "right") - 1
        return w.count, doc, at - w.first[doc], ids


@lru_cache(1)
def index() -> Index:
    return Index()


_HITS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("hits", T.ArrayType(T.IntegerType())), ("places", T.ArrayType(T.LongType()))]


def _phrase_places(phrase: list[int], doc: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which hits begin the phrase: its words are hits in a row."""
    at = np.flatnonzero(ids == phrase[0])
    for j, word in enumerate(phrase[1:], 1):
        at = at[at + j < len(ids)]
        at = at[(ids[at + j] == word) & (doc[at + j] == doc[at]) & (place[at + j] == place[at] + j)]
    return at


def _scan(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index()
        for batch in batches:
            for rows, buf, off in tc.slices(batch, text_col):
                count, doc, place, ids = ix.find(buf, off)
                n = len(count)
                total, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
                labels: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in ix.base:
                    at = _phrase_places(phrase, doc, place, ids)
                    np.add.at(total, doc[at], 1)
                    np.minimum.at(first, doc[at], place[at])
                    np.maximum.at(last, doc[at], place[at])
                    for d in np.unique(doc[at]).tolist():
                        labels[d].add(label)
                whole = [_phrase_places(k, doc, place, ids) for k in ix.keys]
                words = np.flatnonzero(ids < len(ix.words))
                at = np.concatenate([words, *whole])
                ids = np.concatenate([ids[words], np.repeat(len(ix.words) + np.arange(len(whole)), [len(x) for x in whole])])
                order = np.argsort(at, kind="stable")
                at, ids = at[order], ids[order]
                doc, place = doc[at], place[at]
                ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                none = total == 0
                cols = [tc.id_array(rows, id_col), pa.array(count), pa.array(total), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in labels], pa.string())]
                cols += [pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, [id_col, *(c for c, _ in _HITS)])

    return run


def match_templates(ix: Index, idf: np.ndarray, ends: np.ndarray, hits: np.ndarray, places: np.ndarray) -> list[dict[str, float]]:
    """Labels of the templates found in each file, with scores. File i has the hits from ends[i] to ends[i + 1], in order of their places."""
    found: list[dict[str, float]] = [{} for _ in ends[1:]]
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    some = np.flatnonzero(np.diff(ends))
    if not len(some):
        return found
    margin = SLACK + max(p for places in ix.templates for p, _ in places)
    # the files' places side by side on one line, far enough apart that no template meets two of them
    room = np.zeros(len(found), np.int64)
    room[some] = places[ends[some + 1] - 1] + 2 * margin + 1
    first = np.cumsum(room) - room
    line = first[doc] + places + margin
    in_file = np.zeros((len(found), len(ix.words) + len(ix.keys)), bool)
    in_file[doc, hits] = True
    for t, wanted in enumerate(ix.templates):
        words = np.array([w for _, w in wanted])
        weight = idf[words]
        least = MIN_SCORE * weight.sum() - 1e-9
        may = in_file[:, words] @ weight >= least  # files that hold enough of its words at all, and its phrases
        may &= in_file[:, [len(ix.words) + k for k, _ in ix.phrases[t]]].all(1)
        mine = np.flatnonzero(may[doc])
        if not len(mine):
            continue
        own_hits, own_line = hits[mine], line[mine]
        near = range(-SLACK, SLACK + 1)
        # shifts at which all key phrases stand, word by word
        shifts = None
        for k, p in ix.phrases[t]:
            at = own_line[own_hits == len(ix.words) + k] - p
            at = np.unique(np.concatenate([at + d for d in near]))
            shifts = at if shifts is None else np.intersect1d(shifts, at, assume_unique=True)
        if shifts is None or not len(shifts):
            continue
        sums, agree = np.zeros(len(shifts)), np.zeros((len(shifts), len(set(words.tolist()))), bool)
        column = {w: i for i, w in enumerate(dict.fromkeys(words.tolist()))}
        for p, w in wanted:
            at = own_line[own_hits == w] - p
            there = np.isin(shifts, np.concatenate([at + d for d in near]))
            sums += idf[w] * there
            agree[:, column[w]] |= there
        ok = (sums >= least) & (agree.sum(1) >= min(AGREE, len(column)))
        file = np.searchsorted(first, shifts[ok], "right") - 1
        best = np.zeros(len(found))
        np.maximum.at(best, file, sums[ok])
        for d in np.unique(file).tolist():
            found[d][ix.labels[t]] = float(best[d] / weight.sum())
    return found


def _label(idf: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, weight = index(), np.array(idf)
        for b in batches:
            base, hits, places = (b.column(b.schema.get_field_index(c)) for c in ("base_labels", "hits", "places"))
            ends = hits.offsets.to_numpy().astype(np.int64)
            ends, hits, places = ends - ends[0], hits.flatten().to_numpy(), places.flatten().to_numpy()
            labels, scores, lo = [], [], 0
            while lo < len(base):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _HITS_AT_ONCE, "right")) - 1)
                part = slice(ends[lo], ends[hi])
                for own, found in zip(base[lo:hi].to_pylist(), match_templates(ix, weight, ends[lo : hi + 1] - ends[lo], hits[part], places[part])):
                    labels.append(",".join(sorted({*found, *own.split(",")} - {""})))
                    scores.append(1.0 if own else min(1.0, max(found.values(), default=0.0)))
                lo = hi
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:6], "labels", "score"])

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of df."""
    ship(df.sparkSession)
    hits = df.select(id_col, text_col).mapInArrow(_scan(id_col, text_col), T.StructType([df.schema[id_col], *(T.StructField(c, t) for c, t in _HITS)]))
    hits = materialize(hits, "licence-hits")
    n = hits.count()
    df_of = Counter(dict(hits.select(F.explode(F.array_distinct("hits")).alias("w")).groupBy("w").count().collect()))  # a row per licence word
    idf = [math.log((1 + n) / (1 + df_of[i])) + 1 for i in range(len(index().words))]
    schema = T.StructType([*hits.schema.fields[:6], T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())])
    return hits.mapInArrow(_label(idf), schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
