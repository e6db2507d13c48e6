"""Lexer, query splitter and search against step-by-step transcriptions of their rules."""

import random
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import functions as F

from quirefold.functions import lexer, scalars
from quirefold.operators import index, regex_search, search

PIECES = ["<", ">", '"', "'", "&", ";", "#", "a", "B", "é", " ", "amp", "lt", "x41", "233", "&eacute;", "&hellip;", "<b>", "-", "Ü", "你", "$_", "𐀀", "<!--", "8364", "&#", "&amp;", "٣", "\n"]


def is_word(c):
    return (c.isalpha() or unicodedata.category(c) == "Nd") and ord(c) <= 0xFFFF


def slow_words(html, stop=()):
    out, word, state, quote, entity = [], "", "text", "", ""

    def put(c):
        nonlocal word
        if ord(c) < 128 and (c.isalnum() or c in "$_'"):
            word += c
            return
        if word:
            if word.lower() not in stop:
                out.append(word.lower())
            word = ""
        if ord(c) >= 128 and is_word(c) and c not in stop:
            out.append(c)

    def value(e):
        body = e[1:-1]
        if not e.endswith(";") or not 2 <= len(body) <= 6:
            return e
        if body[0] == "#":
            digits, base = (body[2:], 16) if body[1] in "xX" else (body[1:], 10)
            ok = digits and all(c in "0123456789abcdefABCDEF"[: 10 if base == 10 else 22] for c in digits)
            return chr(int(digits, base)) if ok else e
        c = name2codepoint.get(body)
        return chr(c) if c in (34, 38, 60, 62) or c and 160 <= c <= 255 else e

    i = 0
    while i < len(html):
        c = html[i]
        if state == "tag":
            if c in "\"'":
                state, quote = "quote", c
            elif c == ">":
                state = "text"
        elif state == "quote":
            if c == quote:
                state = "tag"
        elif state == "entity":
            if is_word(c) or (entity == "&" and c == "#"):
                entity += c
            else:
                state = "text"
                if c not in ";<":
                    if entity == "&":
                        put("&")
                    continue
                for x in value(entity + (";" if c == ";" else "")):
                    put(x)
        elif c == "<":
            state = "tag"
            put(" ")
        elif c == "&":
            state, entity = "entity", "&"
        else:
            put(c)
        i += 1
    put(" ")
    return out


def test_lexer(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<" * 5000, "a" * 30000, "<a '" + "x" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for stop in ((), ("b", "é", "ab")):
        got = {x.i: x.w for x in df.select("i", lexer.words(F.col("t"), stop).alias("w")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == slow_words(t, stop), t


def slow_split(query, stop=()):
    """(word, whether it begins a phrase) in order."""
    out, word, phrase, quote = [], "", False, False
    for c in query + "\0":
        plain = ord(c) < 128 and (c.isalnum() or c in "$_'")
        if plain:
            word += c
            continue
        if word:
            if word.lower() not in stop:
                out.append((word.lower(), not phrase))
            word, phrase = "", True
        if c == '"':
            quote = not quote
        elif c == " " and not quote:
            phrase = False
        if ord(c) >= 128 and is_word(c):
            if c not in stop:
                out.append((c, not phrase))
            phrase = True
    return out


def random_queries(n, seed):
    r = random.Random(seed)
    parts = ["a", "b", "c", "the", '"', " ", " ", "-", ",", "\t", "é", "你", "A", "ü"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_split_query():
    for q in random_queries(3000, 3):
        for stop in ((), ("the", "b")):
            groups = []
            for w, first in slow_split(q, stop):
                if first or not groups:
                    groups.append([w])
                else:
                    groups[-1].append(w)
            assert search.split_query(q, stop) == groups, q


def slow_search(docs, groups):
    out = []
    for d, words in docs.items():
        m = [sum(words[p : p + len(g)] == g for p in range(len(words))) for g in groups]
        if groups and all(m):
            out.append((d, sum(m)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_search(spark, tmp_path):
    r = random.Random(11)
    texts = {i: " ".join(r.choice(["a", "b", "c", "the", "é", "你", "abc", "<b>a</b>", "a-b"]) for _ in range(r.randint(0, 14))) for i in range(60)}
    queries = [q for q in random_queries(80, 5)]
    for stop in ((), ("the",)):
        docs = {i: slow_words(t, stop) for i, t in texts.items()}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        found = search.rank(search.match(index.tokens(df, stop_words=stop), search.query_terms(spark, list(enumerate(queries)), stop)))
        got = {}
        for x in found.orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.doc_id, x.score))
        for i, q in enumerate(queries):
            assert got.get(i, []) == slow_search(docs, search.split_query(q, stop)), q
    post = index.postings(index.tokens(df))
    index.write_index(post, str(tmp_path / "i"))
    back = index.explode_postings(index.read_index(spark, str(tmp_path / "i")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.tokens(df).collect()))


def test_prefix_and_long_words(spark):
    df = spark.createDataFrame([(0, "alpha alphabet beta"), (1, "alp xalpha"), (2, "abcdefghijklmnopqrstuvw alpha")], "doc_id long, text string")
    run = lambda q, prefix: {(x.doc_id, x.score) for x in search.match(index.tokens(df), search.query_terms(spark, [(0, q)], prefix=prefix)).collect()}
    assert run("alp", True) == {(0, 2), (1, 1), (2, 1)} and run("alp", False) == {(1, 1)}
    assert run("alpha be", True) == {(0, 3)} and run('"alph be"', True) == set()
    assert run("abcdefghijklmnopqrstuvw", False) == set() and run("", False) == set()


def test_regex_query(spark):
    cases = {
        "abc abc": ["abc", "abc"], '"query string" (go)*': [r"\Qquery string\E", "(go)*"], r"Http[a-zA-Z]*Request\(.*\);": ["Http[a-zA-Z]*Request(.*);"],
        '""': [], "a\\": ["a"], '"open': [r"\Qopen"], r"a\ b \d+": [r"a\ b", r"\d+"], "": [], '"a" b': [r"\Qa\E", "b"],
    }
    for q, want in cases.items():
        assert regex_search.split_regex_query(q) == want, q
    df = spark.createDataFrame([(0, "x (go) y"), (1, "query string"), (2, "nothing")], "ord long, text string")
    assert [r.ord for r in regex_search.regex_search(df, '"query string" y$').collect()] == [0, 1]
    assert [r.ord for r in regex_search.regex_search(df, "o", limit=2).collect()] == [0, 2] and regex_search.regex_search(df, "").count() == 0
    assert [r.ord for r in regex_search.regex_search(df, r"\(go\)", raw=True).collect()] == [0]


def test_scalars(spark):
    one = lambda c, *v: spark.range(1).select(c(*(F.lit(x) for x in v))).first()[0]
    assert [one(scalars.mime_type, p) for p in ("/A.HTML", "/x.hhc", "/a.b/c", "/i.ico", "/n.JPE")] == ["text/html", "text/text", "application/octet-stream", "image/x-icon", "image/jpeg"]
    assert [one(scalars.is_text_file, p) for p in ("/a.XHTML", "/a.css", "/a")] == [True, False, False]
    assert [one(scalars.fix_link, p) for p in ("/", "/chmweb/a", "/b")] == ["/nonchmweb/", "/nonchmweb/a", "/b"]
    assert [one(scalars.fix_encoding, p) for p in ("Latin1", "CP1252", "GBK")] == ["UTF8", "UTF8", "GBK"]
    assert one(scalars.query_parameters, "q=a+b%20c&x=&y=1=2&q=z&id=7") == {"q": "z", "id": "7"}
    assert one(scalars.decode_url_path, "a+b%2Fc") == "a+b/c" and one(scalars.file_stem, "/d/b.x.chm") == "b"
    assert scalars.highlight_terms('a AND b "c d",e+(f)') == ["a", "b", "c d", "e", "f"]
    assert one(lambda t: scalars.highlight(t, '"c D" x'), "a C d X") == 'a <span class="searchword">C d</span> <span class="searchword">X</span>'
