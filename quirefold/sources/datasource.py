"""The data source "chm": tables of help archives, a file or some small ones in a partition.

Options: path (a file, a folder or a pattern), what: archives, units, objects, topics or fts, and only: without_index leaves
out the archives that have a word index of their own, of which then no object is decoded. Filters on the
path of a unit and on its flags are taken by the source, so that objects that aren't asked for are not decoded, and
so are those on the word of a posting, for which the tree of words is gone down.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quirefold.common import ship
from quirefold.sources.chm import CONTENTS, Archive, WordIndex, parse_contents

SCHEMAS = {
    "archives": "archive_id string, file_path string, title string, home_file string, topics_file string, index_file string, generator string, lcid int, itsf_lang_id int, encoding string, has_index boolean",
    "units": "archive_id string, ord int, path string, path_key string, space int, start bigint, length bigint, flags int",
    "objects": "archive_id string, ord int, path string, path_key string, flags int, content binary, text string",
    "topics": "archive_id string, id int, parent_id int, ord int, level int, title string, path string",
    "fts": "archive_id string, word string, context int, doc_id int, url string, title string, tf int, positions array<int>",
}


#: Bytes of files in a row up to which they share a partition; a larger file has one to itself.
PARTITION_BYTES = 4 << 20


class FilePartition(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class ChmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.what, self.without_index = options["path"], options.get("what", "units"), options.get("only") == "without_index"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if (self.what in ("units", "objects") and column in ("path", "path_key", "flags")) or (self.what == "fts" and column == "word"):
                if isinstance(f, EqualTo):
                    self.tests.append((column, "in", (f.value,)))
                    continue
                if isinstance(f, In):
                    self.tests.append((column, "in", tuple(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.tests.append((column, "starts", (f.value,)))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        path = self.path
        files = sorted(glob.glob(os.path.join(path, "**", "*.[cC][hH][mM]"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        groups, room = [], 0
        for f in files:
            room -= (size := os.path.getsize(f))
            if room < 0 or not groups:
                groups.append([])
                room = PARTITION_BYTES - size
            groups[-1].append(f)
        return [FilePartition(g) for g in groups]

    def _wanted(self, path: str, flags: int) -> bool:
        have = {"path": path, "path_key": path.lower(), "flags": flags}
        return all(have[c] in v if kind == "in" else have[c].startswith(v) for c, kind, v in self.tests)

    def _postings(self, index: WordIndex) -> Iterator[tuple[str, int, int, list[int]]]:
        """All postings, or those that the filters on the word ask for, by going down to them."""
        if not self.tests:
            yield from index.postings()
            return
        _, kind, values = self.tests[0]
        for v in dict.fromkeys(v for v in values if v is not None):
            for row in index.postings(v, kind == "in"):
                if all(row[0] in o if k == "in" else row[0].startswith(o[0]) for _, k, o in self.tests):
                    yield row

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            yield from self._rows(os.path.abspath(path))

    def _rows(self, name: str) -> Iterator[tuple]:
        with Archive(name) as a:
            if self.without_index and a.searchable:
                return
            if self.what == "archives":
                yield name, name, a.title, a.home, a.topics_file, a.index_file, a.generator, a.lcid, a.lang_id, a.encoding, a.searchable
            elif self.what == "units":
                for u in a.entries:
                    if self._wanted(u.path, u.flags):
                        yield name, u.ord, u.path, u.path.lower(), u.space, u.start, u.length, u.flags
            elif self.what == "objects":
                # in the order of the compressed stream, so that each interval is decoded once
                for u in sorted((u for u in a.entries if self._wanted(u.path, u.flags)), key=lambda u: (u.space, u.start)):
                    yield name, u.ord, u.path, u.path.lower(), u.flags, a.content(u), a.text(u)
            elif self.what == "topics":
                text = a.text(a.units.get(CONTENTS))
                for row in parse_contents(text) if text is not None else ():
                    yield name, *row
            elif self.what == "fts":
                index, topics = WordIndex(a), {}
                for word, context, doc, places in self._postings(index):
                    if doc not in topics:
                        topics[doc] = index.topic(doc)
                    if topics[doc]:
                        yield name, word, context, doc, topics[doc][0], topics[doc][1], len(places), places
            else:
                raise ValueError(f"what must be one of {', '.join(SCHEMAS)}")


class ChmDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chm"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "units")]

    def reader(self, schema) -> DataSourceReader:
        return ChmReader(self.options)


def read_chm(spark: SparkSession, path: str, what: str = "units", only: str = "") -> DataFrame:
    """A table of the archives at path, which the executors must be able to open. Filters stay with the reader, so a table is for one set of them: open another for a query that unites or joins differently filtered parts."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChmDataSource)
    return spark.read.format("chm").option("what", what).option("only", only).load(path)
