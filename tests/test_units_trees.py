import json

from pyspark.sql import functions as F

from quirefold.operators import sinks, trees, units

PATHS = ["/", "/#SYSTEM", "/$FIftiMain", "/a", "/A/b/", "/ab.html", "/a/x/y.html", "/a/x/z.html", "/c/", "/c/d.html", "/toc.hhc", "/TOC.HHC", "/x.hhk", "::DataSpace/x", "/Ab.html"]


def table(spark, paths=PATHS):
    rows = [("arc", i, p, p.lower(), 10 * i) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "archive_id string, ord int, path string, path_key string, length long")
    return df.withColumn("flags", units.unit_flags(F.col("path")))


def test_flags(spark):
    got = {r.path: (r.flags, r.k) for r in table(spark).withColumn("k", units.type_label(F.col("flags"))).collect()}
    assert got["/"] == (17, "normal dir") and got["/#SYSTEM"] == (12, "special file") and got["/toc.hhc"] == (2, "meta") and got["/TOC.HHC"] == (9, "normal file")
    assert got["::DataSpace/x"] == (10, "meta file") and got["/x.hhk"][0] == 2
    listed = lambda what: [r.path for r in units.enumerate_units(table(spark), what).collect()]
    assert "/toc.hhc" not in listed(units.ALL) and "/toc.hhc" in listed(7) and set(listed(2)) == {"/toc.hhc", "/x.hhk", "::DataSpace/x"}
    assert listed(units.USER) == [p for p in PATHS if got[p][0] & 1]


def test_directory_map(spark):
    m = {r.path_key: (r.ord, r.path, r.length) for r in units.directory_map(table(spark)).collect()}
    assert m["/ab.html"] == (5, "/Ab.html", 140) and len(m) == len({p.lower() for p in PATHS})
    assert units.contents_alias(table(spark)).first().path == "/TOC.HHC"
    assert units.resolve(table(spark), "/TOC.hhc").count() == 2 and units.resolve(table(spark), "/none").count() == 0


def test_enumerate_dir(spark):
    one = lambda p, what=units.USER: [(r.path, r.length, r.flags) for r in units.enumerate_dir(table(spark), p, what).collect()]
    assert one("/") == [("/a", 30, 9), ("/A/", 0, 17), ("/ab.html", 50, 9), ("/a/", 0, 17), ("/c/", 80, 17), ("/TOC.HHC", 110, 9), ("/Ab.html", 140, 9)]
    assert one("/a") == [("/a/x/", 0, 17)] and one("/c/") == [("/c/d.html", 90, 9)] and one("/none") == []
    assert one("/", 1 | units.DIRS) == [("/A/", 0, 17), ("/a/", 0, 17), ("/c/", 80, 17)]
    rows = [(r.name, r.href, r.size, r.is_dir) for r in units.directory_listing(table(spark), "/c").collect()]
    assert rows == [("..", "/nonchmweb/", None, True), ("d.html", "/c/d.html", 90, False)]


def test_byte_range(spark):
    df = spark.createDataFrame([(bytearray(b"0123456789"),), (bytearray(b""),), (None,)], "c binary")
    cut = lambda a, n: [None if r[0] is None else bytes(r[0]) for r in df.select(units.byte_range(F.col("c"), a, n)).collect()]
    assert cut(3, 4) == [b"3456", None, None] and cut(8, 9) == [b"89", None, None] and cut(10, 1) == cut(-1, 5) == [None] * 3


def test_files_tree(spark):
    df = table(spark, ["/", "/a/b/c.html", "/a/b/d.html", "/a/e.html", "/f/", "/f/g.html", "/h.html"]).filter(units.matches(F.col("flags"), units.USER))
    tree = trees.files_tree(df, home="/chmweb/x")
    rows = [tuple(r) for r in tree.orderBy("ord", "level").collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [
        (0, None, "/", ""), (None, "/", "/chmweb/x", "Main Page"), (None, "/", "/nonchmweb/", "Root Directory"), (1, "/", "/a/", "a/"), (2, "/a/", "/a/b/", "b/"),
        (None, "/a/b/", "/a/b/c.html", "c.html"), (None, "/a/b/", "/a/b/d.html", "d.html"), (None, "/a/", "/a/e.html", "e.html"), (3, "/", "/f/", "f/"), (None, "/f/", "/f/g.html", "g.html"), (None, "/", "/h.html", "h.html"),
    ]
    got = json.loads(trees.tree_json(rows, key="path"))
    assert got[2] == ["/a/", "a/", [["/a/b/", "b/", [["/a/b/c.html", "c.html"], ["/a/b/d.html", "d.html"]]], ["/a/e.html", "e.html"]]] and got[0] == ["/nonchmweb/x", "Main Page"]
    assert json.loads(trees.tree_json(rows, key="path", most=1))[2] == ["/a/", "a/", "load-by-id", 1]
    assert {r.path for r in trees.path_subtree(tree, 2).collect()} == {"/a/b/", "/a/b/c.html", "/a/b/d.html"}
    cut = {r.path: r.load_by_id for r in trees.limit_depth(tree, 2).collect()}
    assert cut["/a/b/"] and not cut["/a/e.html"] and "/a/b/c.html" not in cut and trees.depth_limit(10_001) == 2


def test_topics(spark):
    rows = [("x", 0, None, 0, 0, "<Top>", ""), ("x", 1, 0, 0, 1, "A", "/a"), ("x", 2, 1, 0, 2, "B", "/b"), ("x", 3, 2, 0, 3, "C", "/A"), ("x", 4, 0, 1, 1, "", "")]
    t = spark.createDataFrame(rows, "archive_id string, id int, parent_id int, ord int, level int, title string, path string")
    assert sorted(r.id for r in trees.topic_subtree(t, 1).collect()) == [1, 2, 3] and sorted(r.id for r in trees.topic_subtree(t, 4).collect()) == [4]
    assert {r.path_key: r.title for r in trees.titles(t).collect()} == {"/a": "C", "/b": "B"}
    got = trees.tree_json([(r[1], r[2], r[4], r[6], r[5]) for r in rows])
    assert json.loads(got) == [["/a", "A", [["/b", "B", [["/A", "C"]]]]], []]
    line = t.filter("id = 2").select(trees.indented(F.col("level"), F.col("title"), F.col("path"))).first()[0]
    assert line == "        B\t/b"


def test_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([(0, 2, "/b", "B\"x"), (0, 1, "/a", "A")], "query_id long, rank int, path string, topic string")
    assert json.loads(sinks.search_json(ranked).first().json) == {"ok": True, "results": [["/a", "A"], ["/b", 'B"x']]}
    arc = spark.createDataFrame([("x", "T", "CP1252", "/h", True)], "archive_id string, title string, encoding string, home_file string, has_index boolean")
    assert json.loads(sinks.info_json(arc, -1).first().json) == {"title": "T", "encoding": "CP1252", "homeFile": "/h", "hasIndex": True, "buildIndexStep": -1, "ok": True}
    objects = spark.createDataFrame([("/d/f.txt", bytearray(b"hi")), ("/e/", None), ("/../../evil", bytearray(b"x")), ("::meta", bytearray(b"y"))], "path string, content binary")
    got = {r.path: r.written for r in sinks.extract(objects, str(tmp_path / "o" / "p")).collect()}
    assert got == {"/d/f.txt": True, "/e/": True, "/../../evil": False} and (tmp_path / "o/p/d/f.txt").read_bytes() == b"hi" and not (tmp_path / "evil").exists()
