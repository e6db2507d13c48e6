import os
import random

import pytest

from quirefold.engine import Archives, Corpus
from quirefold.sources.charsets import charset_of, decode
from quirefold.sources.chm import Archive, ByteBits, ChmError, WordIndex, encint, parse_contents
from quirefold.sources.lzx import Inflator
from quirefold.sources import writer as w

TOC = b"""<HTML><!-- x --><UL><LI><OBJECT type="text/sitemap"><param name="Name" value="One"><param name="Local" value="./a.html"></OBJECT>
<UL><LI><OBJECT type="text/sitemap"><param name="Name" value="Two"><param name="Local" value="sub/b.html"></OBJECT></UL>
<LI><OBJECT type="text/sitemap"><param name="Name" value="No page"></OBJECT></UL></UL></HTML>"""
SYSTEM = w.system([(4, (0x407).to_bytes(4, "little")), (0, b"toc.hhc\0"), (2, b"a.html\0"), (3, "Grüße\0".encode("cp1252")), (9, b"gen 1\0"), (77, b"xx")])


def pages():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "<b>bold</b>", "&eacute;t&eacute;"]
    return [(f"/sub/p{i}.html", " ".join(r.choice(words) for _ in range(r.randint(5, 4000))).encode()) for i in range(12)]


def test_numbers():
    for n in (0, 1, 127, 128, 300, 1 << 20, (1 << 35) + 5):
        assert encint(w.encint(n) + b"\x01", 0) == (n, len(w.encint(n)))
    for root in (0, 1, 2, 5):
        for n in (0, 1, 2, 3, 7, 8, 100, 65535):
            b = w.ByteBits()
            b.scaled(n, root)
            b.align()
            assert ByteBits(b.bytes()).scaled(root) == n


def test_charsets():
    assert [charset_of(x) for x in (0x0409, 0x0804, 0x0404, 0x0411, 0x0412, 0x0419, 0x0C1A, 0x043A, 0x9999)] == ["CP1252", "GBK", "Big5", "Shift-JIS", "eucKR", "CP1251", "CP1251", "Latin1", "UTF-8"]
    assert decode(b"\xc4\xe3", "GBK") == "你" and decode(b"a\xff", "TSCII") == "a�" and decode(b"\xe9", "Latin1") == "é"


@pytest.mark.parametrize("kinds", [(3,), (1,), (2,), (1, 3, 2), (3, 1)])
def test_lzx_round_trip(kinds):
    r = random.Random(len(kinds))
    data = b"".join(r.choice([b"abcabcabd", b"hello world ", bytes([r.randrange(256)]) * r.randint(1, 40), os.urandom(5)]) for _ in range(9000))[:100_000]
    comp, table, _ = w.lzx_section(data, kinds)
    offsets = [int.from_bytes(table[0x28 + 8 * i : 0x30 + 8 * i], "little") for i in range((len(table) - 0x28) // 8)] + [len(comp)]
    out, inf = b"", Inflator(15)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if i % 2 == 0:
            inf.reset()
        out += inf.inflate(comp[a:b], 0x8000)
    assert out[: len(data)] == data


def test_call_translation():
    plain = bytearray(random.Random(1).randbytes(0x8000).replace(b"\xe8", b"\x01"))
    coded = bytearray(plain)
    for at, rel in ((100, 500), (9000, -200)):
        plain[at : at + 5] = b"\xe8" + rel.to_bytes(4, "little", signed=True)
        coded[at : at + 5] = b"\xe8" + (rel + at).to_bytes(4, "little", signed=True)
    comp, _, _ = w.lzx_section(bytes(coded), (3,), e8_size=100_000)
    assert Inflator(15).inflate(comp, 0x8000) == bytes(plain)


def test_contents_tree():
    rows = parse_contents(TOC.decode())
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in rows] == [(0, None, 0, "<Top>", ""), (1, 0, 1, "One", "/a.html"), (2, 1, 2, "Two", "/sub/b.html"), (3, 0, 1, "No page", "")]
    assert parse_contents("<UL></UL></UL><object><param>") == [(0, None, 0, 0, "<Top>", "")]


@pytest.mark.parametrize(("version", "kinds"), [(3, (3,)), (2, (1, 2)), (3, (2, 1, 3))])
def test_archive(tmp_path, version, kinds):
    body = pages()
    stored = [("/", b""), ("/#SYSTEM", SYSTEM), ("/a.html", b"<title>A</title>first"), ("/A.HTML", b"second one"), ("/toc.hhc", TOC)]
    path = str(tmp_path / "t.chm")
    w.write_chm(path, stored, body, kinds, version, page_size=0x200)
    with Archive(path) as a:
        assert (a.title, a.home, a.topics_file, a.generator, a.encoding, a.lcid) == ("Grüße", "/a.html", "/toc.hhc", "gen 1", "CP1252", 0x407)
        for name, data in body:
            assert a.content(a.unit(name.upper())) == data
            assert a.content(a.unit(name), 3, 7) == data[3:10]
        assert a.content(a.unit("/a.html")) == b"second one" and a.content(a.unit("/")) is None
        assert a.content(a.unit("/a.html"), -1) is None and a.content(a.unit("/a.html"), 99) is None
        assert a.unit("/@contents").path == "/toc.hhc" and not a.searchable


def test_archive_faults(tmp_path):
    p = tmp_path / "x.chm"
    p.write_bytes(b"nothing of the kind" * 10)
    with pytest.raises(ChmError):
        Archive(str(p))
    q = str(tmp_path / "name.of.book.chm")
    w.write_chm(q, [("/index.html", b"x"), ("/#SYSTEM", w.system([(2, b"\0")]))], lang=0x411)
    with Archive(q) as a:
        assert (a.home, a.title, a.encoding) == ("/index.html", "name", "Shift-JIS") or a.title == "name.of"
    w.write_chm(q, [("/c.txt", b"x")], [("/z.txt", b"y" * 50)], kinds=(3,))
    with Archive(q) as a:
        a.units.pop("::dataspace/storage/mscompressed/controldata")
        a._compression()
        assert a.content(a.unit("/z.txt")) is None and a.content(a.unit("/c.txt")) == b"x"


POSTINGS = {("alpha", 0): {0: [1, 5], 2: [3]}, ("alpha", 1): {1: [0]}, ("alphabet", 0): {1: [2]}, ("beta", 0): {0: [2], 2: [9]}, ("gamma", 0): {2: [4, 200]}}
TOPICS = [("a.html", "First"), ("b.html", ""), ("c.html", "Third")]


@pytest.mark.parametrize("leaf_words", [2, 10])
def test_word_index(spark, tmp_path, leaf_words):
    path = str(tmp_path / "f.chm")
    w.write_chm(path, [("/#SYSTEM", SYSTEM), *w.word_index(POSTINGS, TOPICS, leaf_words)])
    a = Archives(spark, path)
    assert a.info().first()["has_index"]
    rows = {(r.word, r.context, r.url): list(r.positions) for r in a._table("fts").collect()}
    want = {(word, c, "/" + TOPICS[d][0]): p for (word, c), docs in POSTINGS.items() for d, p in docs.items()}
    assert rows == want
    hit = lambda *x, **k: {(r.url, r.topic, r.score) for r in a.search_index(*x, **k).collect()}
    assert hit("alpha", whole_words=True) == {("/a.html", "First", 2), ("/b.html", "b.html", 1), ("/c.html", "Third", 1)}
    assert hit("alpha") == {("/a.html", "First", 2), ("/b.html", "b.html", 2), ("/c.html", "Third", 1)}
    assert hit("alpha", titles_only=True) == {("/b.html", "b.html", 1)}
    assert hit("alpha beta") == {("/a.html", "First", 3), ("/c.html", "Third", 2)}
    assert hit('"alpha beta"') == {("/a.html", "First", 1)}
    assert hit("alpha zzz") == set()
    assert [r.rank for r in a.search("alpha").collect()] == [1, 2, 3]


def test_word_index_descent(tmp_path):
    """A word, a beginning: the same as a filter on all postings, with few nodes read."""
    words = [f"{a}{b}{c}" for a in "bdf" for b in "aeio" for c in ("", "x", "xy", "z")]
    path = str(tmp_path / "d.chm")
    w.write_chm(path, [("/#SYSTEM", SYSTEM), *w.word_index({(x, c): {0: [1], c + 1: [2]} for x in words for c in (0, 1)}, TOPICS, 4, node=1024)])
    with Archive(path) as archive:
        index = WordIndex(archive)
        every = list(index.postings())
        assert len(every) == 4 * len(words)
        read, own = [], archive.content
        archive.content = lambda unit, at=0, n=None: (read.append(at), own(unit, at, n))[1] if unit is index.main and n == index.node_len else own(unit, at, n)
        for start in [*words, "a", "b", "ba", "bb", "c", "dx", "fo", "foxyz", "g", "漢"]:
            for whole in (False, True):
                read.clear()
                got = list(index.postings(start, whole))
                assert start == "漢" or got == [x for x in every if x[0] == start or (not whole and x[0].startswith(start))], start
                assert start in "b漢" or len(read) <= 6


def test_several_archives(spark, tmp_path):
    """Documents of different archives are kept apart, and archives with and without an own index are searched together."""
    for name, body in (("a", b"alpha one"), ("b", b"beta two beta"), ("c", b"alpha and beta gamma")):
        w.write_chm(str(tmp_path / f"{name}.chm"), [("/", b""), ("/#SYSTEM", SYSTEM), ("/x.html", body), ("/toc.hhc", TOC)])
    w.write_chm(str(tmp_path / "own.chm"), [("/#SYSTEM", SYSTEM), *w.word_index(POSTINGS, TOPICS, 2)])
    a = Archives(spark, str(tmp_path))
    hit = lambda *x, **k: [(os.path.basename(r.archive_id)[:-4], r.url, r.score, r.rank) for r in a.search(*x, **k).collect()]
    key = lambda r: r[3]
    assert sorted(hit("alpha beta"), key=key) == [("own", "/a.html", 3, 1), ("c", "/x.html", 2, 2), ("own", "/c.html", 2, 3)]
    assert {r[:3] for r in hit("beta", whole_words=True)} == {("b", "/x.html", 2), ("c", "/x.html", 1), ("own", "/a.html", 1), ("own", "/c.html", 1)}
    assert {r[:3] for r in hit("gam")} == {("c", "/x.html", 1), ("own", "/c.html", 2)} and hit("gam", whole_words=True) == hit("alpha two") == []
    assert [r[3] for r in hit("alpha", limit=2)] == [1, 2] and {r[3] for r in hit("alpha", limit=0)} == {1, 2, 3, 4, 5}
    assert hit("alpha", titles_only=True, whole_words=True) == [("own", "/b.html", 1, 1)]


def test_data_source(spark, tmp_path):
    body = pages()
    for i in range(2):
        w.write_chm(str(tmp_path / f"b{i}.chm"), [("/", b""), ("/#SYSTEM", SYSTEM), ("/a.html", b"caf\xe9 alpha"), ("/toc.hhc", TOC)], body, (1, 2))
    a = Archives(spark, str(tmp_path))
    assert a.info().count() == 2 and a.units().count() == 2 * (4 + len(body) + 3)
    one = a.read("/A.html").collect()
    assert [r.text for r in one] == ["café alpha"] * 2
    assert a._table("objects").filter("path = '/sub/p3.html'").count() == 2
    assert {r.path_key: r.title for r in a.titles().collect()} == {"/a.html": "One", "/sub/b.html": "Two"}
    paths = [r.path for r in a.enumerate(25).filter(f"archive_id LIKE '%b0.chm'").collect()]
    assert paths == ["/", "/a.html", *(n for n, _ in body)]
    docs = a.documents().filter("archive_id LIKE '%b0.chm'").select("doc_id", "path", "title", "text")
    assert docs.filter("path = '/a.html'").first().title == "One"
    found = Corpus(docs).search("alpha beta").collect()
    assert found == sorted(found, key=lambda r: (-r.score, r.doc_id)) and found
    idx = Corpus(docs).build_index(str(tmp_path / "idx")).search("alpha beta").collect()
    assert [(r.url, r.score) for r in idx] == [(r.url, r.score) for r in found]
    out = {r.path: r.written for r in a._table("objects").filter("archive_id LIKE '%b1.chm'").transform(lambda d: __import__("quirefold.operators.sinks", fromlist=["x"]).extract(d, str(tmp_path / "out"))).collect()}
    assert all(out.values()) and (tmp_path / "out/sub/p3.html").read_bytes() == body[3][1]


def test_regex_all_objects(spark, tmp_path):
    path = str(tmp_path / "r.chm")
    w.write_chm(path, [("/", b""), ("/#SYSTEM", SYSTEM), ("/a.html", b"alpha"), ("/b.css", b"p { alpha: 1 }"), ("/c.js", b"x"), ("/d.txt", b"alpha"), ("/toc.hhc", TOC)])
    a = Archives(spark, path)
    found = {r.path: r.doc_id for r in a.search("alp[h]a", regex=True).collect()}
    assert found == {"/a.html": 0, "/b.css": None, "/d.txt": 1}
    assert {r.path: r.doc_id for r in a.documents().collect()} == {"/a.html": 0, "/d.txt": 1}


def test_command_line(spark, tmp_path):
    from quirefold.__main__ import lines
    from quirefold.functions.lexer import read_stop_words

    path = str(tmp_path / "c.chm")
    w.write_chm(path, [("/", b""), ("/#SYSTEM", SYSTEM), ("/a.html", b"alpha beta"), ("/toc.hhc", TOC), ("/sub/b.html", b"beta gamma")])
    run = lambda *x: lines(spark, x[0], path, x[1] if len(x) > 1 else None)
    assert '"encoding":"CP1252"' in run("info")[0] and run("find", "/A.html") == ["/a.html\t10"]
    assert run("dir", "/") == ["12\tspecial file\t/#SYSTEM".replace("12", str(len(SYSTEM))), "10\tnormal file\t/a.html", "0\tnormal dir\t/sub/"]
    assert run("search", "beta gamma") == ["/sub/b.html\tTwo"] and sorted(run("regex", "alph[a-z] g.mma")) == ["/a.html\tOne", "/sub/b.html\tTwo"]
    assert run("topics")[1] == "    One\t/a.html" and run("extract", str(tmp_path / "out")) == [f"5 objects, {len(SYSTEM) + 20 + len(TOC)} bytes"]
    (tmp_path / "stop.txt").write_text("the\n\nof\nthe\n")
    assert sorted(read_stop_words(spark, str(tmp_path / "stop.txt"))) == ["of", "the"]


def _steps(module, f):
    """(result, lines that Python goes through in a module while f runs)."""
    import sys

    n = 0

    def local(frame, event, arg):
        nonlocal n
        n += event == "line"
        return local

    sys.settrace(lambda frame, event, arg: local if frame.f_code.co_filename == module.__file__ else None)
    try:
        return f(), n
    finally:
        sys.settrace(None)


def test_coder_steps():
    """F1 to F6 of r03: writing archives was most of their queries' time, by the bit and by the byte; decoding by several calls a symbol."""
    from quirefold.sources import lzx

    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "<b>bold</b>", *(f"w{i}" for i in range(300))]
    text = " ".join(r.choice(words) for _ in range(20_000)).encode()[:0x10000]
    (comp, table, _), wrote = _steps(w, lambda: w.lzx_section(text, (1,)))
    second = int.from_bytes(table[0x30:0x38], "little")
    inf = Inflator(15)
    out, read = _steps(lzx, lambda: inf.inflate(comp[:second], 0x8000) + inf.inflate(comp[second:], 0x8000))
    assert out == text and wrote < 10 * len(text) and read < 7 * len(text)


def test_small_files_share_a_partition(spark, tmp_path):
    """F4 to F6 of r03: a task for each small archive."""
    from quirefold.sources import datasource

    for i in range(30):
        w.write_chm(str(tmp_path / f"{i:02}.chm"), [("/a.html", b"x")])
    (tmp_path / "none").mkdir()
    parts = datasource.ChmReader({"path": str(tmp_path)}).partitions()
    assert [os.path.basename(f) for p in parts for f in p.value] == [f"{i:02}.chm" for i in range(30)] and len(parts) == 1
    assert Archives(spark, str(tmp_path)).info().count() == 30 and datasource.ChmReader({"path": str(tmp_path / "none")}).partitions() == []
    big = tmp_path / "05.chm"
    big.write_bytes(big.read_bytes() + bytes(datasource.PARTITION_BYTES))
    assert [len(p.value) for p in datasource.ChmReader({"path": str(tmp_path)}).partitions()] == [5, 1, 24]


def test_texts_of_indexed_archives_are_not_read(tmp_path, monkeypatch):
    """F1 of r03: the search decoded the objects of all archives, also of those with their own index."""
    from quirefold.sources.datasource import ChmReader

    w.write_chm(str(tmp_path / "own.chm"), [("/#SYSTEM", SYSTEM), ("/x.html", b"alpha"), *w.word_index(POSTINGS, TOPICS, 2)], [("/y.html", b"beta")])
    w.write_chm(str(tmp_path / "texts.chm"), [("/#SYSTEM", SYSTEM), ("/x.html", b"alpha")], [("/y.html", b"beta")])
    decoded, inflate = [], Inflator.inflate
    monkeypatch.setattr(Inflator, "inflate", lambda self, *x: (decoded.append(1), inflate(self, *x))[1])
    reader = ChmReader({"path": str(tmp_path), "what": "objects", "only": "without_index"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {os.path.basename(r[0]) for r in rows} == {"texts.chm"} and len(decoded) == 1 and [r[6] for r in rows if r[2] == "/y.html"] == ["beta"]


def test_rank_goes_through_its_input_once(spark):
    """F1 and F3 of r03: the range sort ran all that stands before it once more for its sample."""
    from pyspark.sql import functions as F

    from quirefold.operators import search

    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return x % 7

    found = spark.range(500).select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias("doc_id"), F.udf(score, "long")("id").alias("score"))
    rows = sorted(search.rank(found).collect(), key=lambda r: r["rank"])
    assert [(r.doc_id, r["rank"]) for r in rows] == [(d, i) for i, d in enumerate(sorted(range(500), key=lambda d: (-(d % 7), d)), 1)]
    assert seen.value == 500
