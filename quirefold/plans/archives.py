"""The driver's pages written as help archives into the shared folder, and read back through the data source.

An archive holds the pages of BIN ids in a row: by turns stored as they are and compressed (LZX blocks of all three
types), a contents file with a chapter for each host, system records, and a word index of the titles.
"""

from __future__ import annotations

import os
import re
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.common import shared_dir, ship
from quirefold.engine import Archives
from quirefold.plans import virtual
from quirefold.sources import writer

BIN = 64
#: A language without a character set of its own: strings are UTF-8.
LCID = 0xF000


def _contents(pages: list[tuple[str, str]]) -> bytes:
    """A chapter for each host, its pages below it."""
    item = lambda name, local: f'<LI><OBJECT type="text/sitemap"><param name="Name" value="{name}">' + (f'<param name="Local" value="{local}">' if local else "") + "</OBJECT>"
    out, host = ["<HTML><UL>"], None
    for path, title in pages:
        own = path.split("/")[2]
        if own != host:
            out += ["</UL>"] * (host is not None) + [item(own, ""), "<UL>"]
            host = own
        out.append(item(title, path[1:]))
    return "\n".join([*out, "</UL>" * (host is not None), "</UL></HTML>"]).encode()


def write_archive(target: str, number: int, pages: list[tuple[int, str, str | None, str]]) -> None:
    """pages: (id, path, title, markup) in order of path."""
    named = [(path, title or path) for _, path, title, _ in pages]
    postings: dict[tuple[str, int], dict[int, list[int]]] = {}
    for doc, (_, title) in enumerate(named):
        for at, word in enumerate(re.findall("[a-z0-9]+", title.lower())):
            postings.setdefault((word, 1), {}).setdefault(doc, []).append(at)
    records = [(4, struct.pack("<I", LCID)), (0, b"toc.hhc\0"), (2, pages[0][1][1:].encode() + b"\0"), (3, f"Book {number}\0".encode()), (9, b"quirefold\0")]
    stored = [("/#SYSTEM", writer.system(records)), ("/toc.hhc", _contents(named)), *writer.word_index(postings, [(p[1:], t) for p, t in named], leaf_words=40, node=4096, encoding="utf-8")]
    stored += [(path, text.encode()) for id_, path, _, text in pages if id_ % 2]
    packed = [(path, text.encode()) for id_, path, _, text in pages if not id_ % 2]
    writer.write_chm(target, stored, packed, kinds=(1, 3, 2), lang=LCID)


def pages_as_archives(spark: SparkSession, sf: str) -> Archives:
    """Writes the archives, one task each, and opens them."""
    ship(spark)
    folder = f"{shared_dir(spark).removeprefix('file://')}/quirefold/{uuid.uuid4().hex}-archives"
    os.makedirs(folder)
    p = virtual.pages(spark, sf)
    p = p.select((F.col("doc_id") / BIN).cast("long").alias("book"), "doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string"), "path").alias("path"), "title", F.coalesce("text", F.lit("")).alias("text"))

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pages = [(i, path, title, text) for i, path, title, text in zip(rows.doc_id, rows.path, rows.title, rows.text)]
        write_archive(f"{folder}/{key[0]}.chm", int(key[0]), sorted(pages, key=lambda r: (r[1].split("/")[2], r[1])))
        return pd.DataFrame({"book": [key[0]], "pages": [len(pages)]})

    p.groupBy("book").applyInPandas(write, "book long, pages long").agg(F.sum("pages")).collect()
    return Archives(spark, folder)


def book(archive_id: str = "archive_id"):
    return F.regexp_extract(archive_id, r"([0-9]+)\.chm$", 1).cast("long").alias("book")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    a = pages_as_archives(spark, sf)
    return a.entries().filter("flags IN (9, 17)").select(book(), "path", "length", "flags")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    a = pages_as_archives(spark, sf)
    o = a.objects().filter("flags IN (9, 17)")
    return o.select(book(), "path", F.md5(F.coalesce("content", F.lit("").cast("binary"))).alias("digest"), F.md5(F.coalesce("text", F.lit(""))).alias("text_digest"))


def info(spark: SparkSession, sf: str) -> DataFrame:
    return pages_as_archives(spark, sf).info().select(book(), "title", "home_file", "encoding", "generator", "has_index")


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their chapters, through the topic trees."""
    t = pages_as_archives(spark, sf).topics()
    up = t.select("archive_id", F.col("id").alias("parent_id"), F.col("title").alias("chapter"))
    return t.filter("level = 2").join(up, ["archive_id", "parent_id"]).select(book(), "path", F.col("title").alias("topic"), "chapter", F.col("ord").cast("long").alias("place"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    f = pages_as_archives(spark, sf)._table("fts")
    return f.select(book(), "word", "context", "url", F.col("title").alias("topic"), F.array_join("positions", ",").alias("positions"))


def search(spark: SparkSession, sf: str, query: str) -> DataFrame:
    return pages_as_archives(spark, sf).search(query, limit=0).select(book(), "url", "topic", "score")
