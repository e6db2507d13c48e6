"""Queries over the driver's tables, seen as archives, and the same in SQL, by name.

Every query runs over its whole table. Limits are there only where the feature is one (the first 300 results).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import lexer, scalars
from quirefold.operators import index, regex_search, search, sinks, trees, units
from quirefold.plans import archives, virtual
from quirefold.sources.charsets import CHARSETS, DEFAULT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STOP = ("the", "and", "of", "in")
_U = r"^[A-Za-z]+://([^/?#]*)([^?#]*)"
_DOCS = {
    "pages": f"SELECT page_id AS doc_id, '/' || regexp_extract(url, '{_U}', 1) || regexp_extract(url, '{_U}', 2) AS path, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, html AS text FROM pages",
    "documents": "SELECT doc_id, '/' || coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || doc_id || '.txt' AS path, NULL::VARCHAR AS title, text FROM documents",
    "conversations": "SELECT conv_id * 1000 + turn AS doc_id, '/' || conv_id || '/' || turn || '-' || coalesce(role, '') || '.txt' AS path, NULL::VARCHAR AS title, text FROM conversations",
}
_VIEWS = {"pages": virtual.pages, "documents": virtual.documents, "conversations": virtual.conversations}


def _add(name: str, sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def _tokens_sql(table: str, stop: tuple[str, ...] = (), text: str = "text") -> str:
    return f"d AS ({_DOCS[table]}), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {lexer.sql_words(text, stop)} AS w FROM d))"


@_add("tokens_pages", f"WITH {_tokens_sql('pages')} SELECT doc_id, pos::INT AS pos, word FROM t")
def tokens_pages(spark: SparkSession, sf: str) -> DataFrame:
    return index.tokens(virtual.pages(spark, sf), max_word=None)


@_add("token_counts_docs", f"WITH {_tokens_sql('documents')} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word) AS n_distinct FROM t GROUP BY 1")
def token_counts_docs(spark: SparkSession, sf: str) -> DataFrame:
    w = virtual.documents(spark, sf).select("doc_id", lexer.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@_add(
    "index_postings",
    f"WITH {_tokens_sql('pages', STOP)} SELECT word, doc_id, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t WHERE length(word) <= 16 GROUP BY 1, 2",
)
def index_postings(spark: SparkSession, sf: str) -> DataFrame:
    post = index.postings(index.tokens(virtual.pages(spark, sf), stop_words=STOP))
    return post.withColumn("positions", F.array_join("positions", ","))


@_add("dictionary_df", f"WITH {_tokens_sql('documents')} SELECT word, count(DISTINCT doc_id) AS doc_count FROM t WHERE length(word) <= 16 GROUP BY 1")
def dictionary_df(spark: SparkSession, sf: str) -> DataFrame:
    docs = virtual.documents(spark, sf)
    once = docs.select("doc_id", F.explode(F.array_distinct(lexer.words(F.col("text")))).alias("word")).filter(F.length("word") <= lexer.MAX_WORD)
    return index.dictionary(once)


@_add(
    "high_freq_words",
    f"WITH {_tokens_sql('pages')}, n AS (SELECT count(*) AS n FROM d) SELECT word, count(DISTINCT doc_id) AS doc_count FROM t, n WHERE length(word) <= 16 GROUP BY word, n HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) * 100 >= 95 * n",
)
def high_freq_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = virtual.pages(spark, sf)
    dic = index.dictionary(docs.select("doc_id", F.explode(F.array_distinct(lexer.words(F.col("text")))).alias("word")).filter(F.length("word") <= lexer.MAX_WORD))
    return index.high_frequency(dic, docs.count(), least=10)


def _search_sql(table: str, queries: list[tuple[int, str]], stop: tuple[str, ...] = (), prefix: bool = False, limit: int = 0, text: str = "text") -> str:
    rows = []
    for q, s in queries:
        groups = search.split_query(s, stop)
        for g, words in enumerate(groups):
            rows += [f"({q}, {g}, {i}, {len(words)}, {len(groups)}, {lexer._quote(w)}, {str(prefix and len(words) == 1).lower()})" for i, w in enumerate(words)]
    values = f"VALUES {', '.join(rows)}" if rows else "SELECT 0, 0, 0, 0, 0, '', false WHERE false"
    cut = f"WHERE rank <= {limit}" if limit else ""
    return f"""WITH {_tokens_sql(table, stop, text)}, terms(query_id, g, off, len, n, term, prefix) AS ({values}),
    hits AS (SELECT query_id, doc_id, g, len, n, pos - off AS p0, off FROM t JOIN terms ON t.word = term OR (prefix AND starts_with(t.word, term)) WHERE length(t.word) <= 16),
    a AS (SELECT query_id, doc_id, g, n, p0 FROM hits GROUP BY query_id, doc_id, g, len, n, p0 HAVING count(DISTINCT off) = len),
    m AS (SELECT query_id, doc_id, g, n, count(*) AS m FROM a GROUP BY ALL),
    s AS (SELECT query_id, doc_id, sum(m)::BIGINT AS score FROM m GROUP BY query_id, doc_id, n HAVING count(*) = n),
    r AS (SELECT s.query_id::BIGINT AS query_id, s.doc_id, s.score, d.path AS url, coalesce(d.title, d.path) AS topic, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.doc_id))::INT AS rank FROM s JOIN d USING (doc_id))
    SELECT * FROM r {cut}"""


def run_search(spark: SparkSession, docs: DataFrame, queries: list[tuple[int, str]], stop: tuple[str, ...] = (), prefix: bool = False, limit: int = 0, text: str = "text") -> DataFrame:
    found = search.rank(search.match_texts(docs, queries, text, stop, prefix), limit)
    return search.with_titles(found, docs).select("query_id", "doc_id", "score", F.col("path").alias("url"), "topic", "rank")


_SEARCHES = {
    "search_single": ("documents", "letionai", {}),
    "search_and": ("documents", "anea eriner", {}),
    "search_phrase": ("documents", '"anea eriner"', {}),
    "search_hyphen_phrase": ("documents", "anea-eriner the", {}),
    "search_nonascii": ("documents", "für", {}),
    "search_stopword_phrase": ("documents", '"anea the eriner"', {"stop": STOP}),
    "search_ranked": ("documents", 'thing "and attion"', {"limit": 300}),
    "search_prefix": ("pages", "trac exam", {"prefix": True}),
    "search_title_only": ("pages", "the", {"text": "title"}),
    "search_no_hit": ("documents", "qqzzqq anea", {}),
    "search_long_word": ("documents", "abcdefghijklmnopqrs the", {}),
    "search_conversations": ("conversations", "the was", {}),
}
for _name, (_table, _query, _more) in _SEARCHES.items():
    _add(_name, _search_sql(_table, [(0, _query)], **_more))(lambda spark, sf, t=_table, q=_query, m=_more: run_search(spark, _VIEWS[t](spark, sf), [(0, q)], **m))

_BATCH = list(enumerate(["anea eriner", '"anea eriner"', "the anea", '"the anea"', "and-attion", "für", "was of", '"in the"', "tete", "con de", '"de la"', "und der", "x y z"]))
_add("search_batch", _search_sql("documents", _BATCH))(lambda spark, sf: run_search(spark, virtual.documents(spark, sf), _BATCH))

@_add(
    "search_benchmark_phrases",
    f"""WITH {_tokens_sql('documents')}, q AS (SELECT item_id, {lexer.sql_words('text')} AS w FROM benchmark),
    terms AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS off, len(w) AS n FROM q),
    a AS (SELECT item_id, doc_id, pos - off AS p0 FROM t JOIN terms ON word = term GROUP BY item_id, doc_id, pos - off, n HAVING count(DISTINCT off) = n)
    SELECT item_id AS query_id, doc_id, count(*) AS score FROM a GROUP BY 1, 2""",
)
def search_benchmark_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark passage, whole, as a phrase: a batch of queries from a table."""
    passages = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), lexer.words(F.col("text")).alias("words"))
    return search.match_passages(virtual.documents(spark, sf), passages)


def _json_sql(table: str, query: str, limit: int) -> str:
    return f"""WITH found AS ({_search_sql(table, [(0, query)], limit=limit)}) SELECT query_id, '{{"ok":true,"results":[' || string_agg('["' || url || '","' || topic || '"]', ',' ORDER BY rank) || ']}}' AS json FROM found GROUP BY 1"""


@_add("search_json", _json_sql("documents", "anea eriner", 300))
def search_json(spark: SparkSession, sf: str) -> DataFrame:
    found = run_search(spark, virtual.documents(spark, sf), [(0, "anea eriner")], limit=300)
    return sinks.search_json(found.withColumnRenamed("url", "path"))


_REGEX = {
    "regex_or": ("documents", "letionai lesouonmentque[a-z]*", r"regexp_matches(text, 'letionai') OR regexp_matches(text, 'lesouonmentque[a-z]*')"),
    "regex_quoted": ("pages", '"var track" (&copy;|&nbsp;)', r"regexp_matches(text, '\Qvar track\E') OR regexp_matches(text, '(&copy;|&nbsp;)')"),
    "regex_dropped_backslash": ("pages", r"track\(.*\);", r"regexp_matches(text, 'track(.*);')"),
    "regex_class": ("documents", r"[0-9]\d\d-\d", r"regexp_matches(text, '[0-9]\d\d-\d')"),
}
for _name, (_table, _query, _test) in _REGEX.items():
    _add(_name, f"WITH d AS ({_DOCS[_table]}) SELECT doc_id, path, coalesce(title, path) AS topic FROM d WHERE {_test}")(
        lambda spark, sf, t=_table, q=_query: _VIEWS[t](spark, sf).filter(regex_search.any_pattern(F.col("text"), regex_search.split_regex_query(q))).select("doc_id", "path", F.coalesce("title", "path").alias("topic"))
    )


@_add(
    "search_unified",
    f"WITH d AS ({_DOCS['pages']}) SELECT doc_id, path FROM d WHERE regexp_matches(text, 'cheap-pills') UNION ALL SELECT doc_id, url FROM ({_search_sql('pages', [(0, 'track example')], limit=300)})",
)
def search_unified(spark: SparkSession, sf: str) -> DataFrame:
    """One entry for both kinds of search, as the engine chooses them."""
    from quirefold.engine import Corpus

    c = Corpus(virtual.pages(spark, sf))
    return c.search("cheap-pills", regex=True).select("doc_id", "path").unionByName(c.search("track example", limit=300).select("doc_id", F.col("url").alias("path")))


_ENT = "&#?[A-Za-z0-9]+;"
_NAMED_SQL = "MAP {" + ", ".join(f"{lexer._quote(k)}: {lexer._quote(v)}" for k, v in sorted(lexer.ENTITIES.items())) + "}"


@_add("entity_decode", f"SELECT e AS entity, coalesce({_NAMED_SQL}[substr(e, 2, length(e) - 2)], e) AS decoded, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '{_ENT}')) AS e FROM pages) GROUP BY 1, 2")
def entity_decode(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit(_ENT), F.lit(0))).alias("entity"))
    return e.groupBy("entity").agg(F.count("*").alias("n")).select("entity", lexer.decode_entity(F.col("entity")).alias("decoded"), "n")


_FLAGS_SQL = "CASE WHEN path LIKE '%.hhc' OR path LIKE '%.hhk' THEN 2 ELSE (CASE WHEN NOT starts_with(path, '/') THEN 2 WHEN starts_with(path, '/#') OR starts_with(path, '/$') THEN 4 ELSE 1 END) + (CASE WHEN path LIKE '%/' THEN 16 ELSE 8 END) END"


def _units_sql(table: str) -> str:
    return f"u AS (SELECT row_number() OVER (ORDER BY lower(path), doc_id) - 1 AS ord, doc_id, path, lower(path) AS path_key, strlen(text)::BIGINT AS length, ({_FLAGS_SQL})::INT AS flags FROM ({_DOCS[table]}))"


@_add("unit_flags", f"WITH {_units_sql('pages')} SELECT doc_id, path, flags, CASE WHEN flags & 16 <> 0 THEN 'normal dir' ELSE 'normal file' END AS kind FROM u")
def unit_flags(spark: SparkSession, sf: str) -> DataFrame:
    u = virtual.pages(spark, sf).select("doc_id", "path", units.unit_flags(F.col("path")).alias("flags"))
    return u.withColumn("kind", units.type_label(F.col("flags")))


@_add("enumerate_user", f"WITH {_units_sql('pages')} SELECT ord, path, length, flags FROM u WHERE flags & 1 <> 0 AND flags & 24 <> 0")
def enumerate_user(spark: SparkSession, sf: str) -> DataFrame:
    return units.enumerate_units(virtual.units(virtual.pages(spark, sf)), units.USER).select("ord", "path", "length", "flags")


@_add("enumerate_dirs", f"WITH {_units_sql('pages')} SELECT ord, path FROM u WHERE flags & 7 <> 0 AND flags & 16 <> 0")
def enumerate_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return units.enumerate_units(virtual.units(virtual.pages(spark, sf)), 7 | units.DIRS).select("ord", "path")


def _dir_sql(table: str, prefix: str) -> str:
    n = len(prefix)
    return f"""{_units_sql(table)}, i AS (SELECT *, substr(path, {n + 1}) AS rest, regexp_extract(substr(path, {n + 1}), '^/*[^/]*/?') AS child FROM u WHERE starts_with(path, '{prefix}') AND path <> '{prefix}'),
    c AS (SELECT '{prefix}' || child AS path, min(ord) AS ord, coalesce(arg_max(length, ord) FILTER (rest = child), 0)::BIGINT AS length, coalesce(arg_max(flags, ord) FILTER (rest = child), 17)::INT AS flags FROM i GROUP BY child)"""


@_add("enumerate_dir", f"WITH {_dir_sql('documents', '/src0/')} SELECT ord, path, length, flags FROM c WHERE flags & 1 <> 0 AND flags & 24 <> 0")
def enumerate_dir(spark: SparkSession, sf: str) -> DataFrame:
    return units.enumerate_dir(virtual.units(virtual.documents(spark, sf), under="/src0/"), "/src0")


@_add("directory_listing", f"WITH {_dir_sql('documents', '/src1/en/')} SELECT ord, path AS href, substr(path, 10) AS name, CASE WHEN length > 0 THEN length ELSE -1 END AS size, length <= 0 AS is_dir FROM c UNION ALL SELECT -1, '/src1/', '..', -1, true")
def directory_listing(spark: SparkSession, sf: str) -> DataFrame:
    return units.directory_listing(virtual.units(virtual.documents(spark, sf), under="/src1/en/"), "/src1/en").fillna(-1, ["size"])


@_add("resolve_object", f"WITH {_units_sql('documents')} SELECT ord, doc_id, path, path_key, length, flags FROM u WHERE path_key = '/src1/en/1.txt'")
def resolve_object(spark: SparkSession, sf: str) -> DataFrame:
    return units.resolve(virtual.units(virtual.documents(spark, sf), under="/SRC1/En/1.TXT"), "/SRC1/En/1.TXT").select("ord", "doc_id", "path", "path_key", "length", "flags")


@_add("object_slice", "SELECT page_id AS doc_id, CASE WHEN strlen(html) > 100 THEN lower(hex(encode(html)[101:150])) END AS part FROM pages")
def object_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = virtual.pages(spark, sf)
    return p.select("doc_id", F.lower(F.hex(units.byte_range(F.col("text").cast("binary"), 100, 50))).alias("part"))


@_add("text_files", f"SELECT doc_id, path FROM ({_DOCS['pages']}) WHERE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.txt', '.htm', '.html', '.xml', '.xhtml')")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    return virtual.pages(spark, sf).filter(scalars.is_text_file(F.col("path"))).select("doc_id", "path")


@_add("mime_types", f"SELECT doc_id, CASE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) WHEN '.html' THEN 'text/html' WHEN '.htm' THEN 'text/html' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM ({_DOCS['pages']})")
def mime_types(spark: SparkSession, sf: str) -> DataFrame:
    return virtual.pages(spark, sf).select("doc_id", scalars.mime_type(F.col("path")).alias("mime"))


@_add("link_rewrite", f"SELECT doc_id, CASE WHEN p = '/' THEN '/nonchmweb/' WHEN starts_with(p, '/chmweb/') THEN '/nonchmweb/' || substr(p, 9) ELSE p END AS link FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/chmweb' || path ELSE path END AS p FROM ({_DOCS['pages']}))")
def link_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    p = virtual.pages(spark, sf).select("doc_id", F.when(k == 0, "/").when(k == 1, F.concat(F.lit("/chmweb"), "path")).otherwise(F.col("path")).alias("p"))
    return p.select("doc_id", scalars.fix_link(F.col("p")).alias("link"))


@_add("query_parameters", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#=]+)(&|#|$)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#=]+)(&|#|$)', 1), '') AS utm_source FROM pages")
def query_parameters(spark: SparkSession, sf: str) -> DataFrame:
    m = scalars.query_parameters(F.regexp_extract("url", r"\?([^#]*)", 1))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", m.alias("m")).select("page_id", F.try_element_at("m", F.lit("page")).alias("page"), F.try_element_at("m", F.lit("utm_source")).alias("utm_source"))


_TREE = f"""{_units_sql('documents')}, own AS (SELECT ord, path, string_split(path, '/') AS parts FROM u WHERE path <> '/'),
    up AS (SELECT ord, unnest(range(1, len(parts) - 1)) AS level, parts FROM own),
    n AS (SELECT path, level, min(ord) AS ord FROM (SELECT ord, path, len(parts) - 1 AS level FROM own UNION ALL SELECT ord, array_to_string(parts[1:level + 1], '/') || '/', level FROM up) GROUP BY 1, 2),
    tree AS (SELECT CASE WHEN path LIKE '%/' THEN (row_number() OVER (PARTITION BY path LIKE '%/' ORDER BY ord, level))::INT END AS id, regexp_extract(path, '^(.*/)[^/]+/?$', 1) AS parent_path, level::INT AS level, path, regexp_extract(path, '([^/]+/?)$', 1) AS title, ord FROM n
             UNION ALL VALUES (0, NULL, 0, '/', '', -3), (NULL, '/', 1, '/nonchmweb/', 'Main Page', -2), (NULL, '/', 1, '/nonchmweb/', 'Root Directory', -1))"""


@_add("files_tree", f"WITH {_TREE} SELECT * REPLACE (coalesce(id, -1) AS id) FROM tree")
def files_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf).fillna(-1, ["id"])


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return trees.files_tree(virtual.units(virtual.documents(spark, sf)))


@_add("subtree_by_id", f"WITH {_TREE} SELECT tree.* REPLACE (coalesce(id, -1) AS id) FROM tree JOIN (SELECT path AS r FROM tree WHERE id = 1) ON starts_with(path, r)")
def subtree_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return trees.path_subtree(_tree(spark, sf), 1).fillna(-1, ["id"])


@_add("tree_depth_limit", f"WITH {_TREE} SELECT tree.* REPLACE (coalesce(id, -1) AS id), id IS NOT NULL AND path IN (SELECT parent_path FROM tree WHERE level = 3) AS load_by_id FROM tree WHERE level <= 2")
def tree_depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    return trees.limit_depth(_tree(spark, sf), trees.SHALLOW).fillna(-1, ["id"])


@_add("tree_lines", f"WITH {_TREE} SELECT ord, repeat('    ', level) || title || chr(9) || path AS line FROM tree")
def tree_lines(spark: SparkSession, sf: str) -> DataFrame:
    return files_tree(spark, sf).select("ord", trees.indented(F.col("level"), F.col("title"), F.col("path")).alias("line"))


@_add("object_titles", f"SELECT path, coalesce(title, path) AS topic FROM ({_DOCS['pages']})")
def object_titles(spark: SparkSession, sf: str) -> DataFrame:
    return virtual.pages(spark, sf).select("path", F.coalesce("title", "path").alias("topic"))


_CHARSET_VALUES = ", ".join(f"({k}, '{v}')" for k, v in sorted(CHARSETS.items()))


@_add("encoding_lookup", f"SELECT p_partkey, coalesce(e, '{DEFAULT}') AS encoding, CASE WHEN e = 'Latin1' OR e LIKE 'CP%' THEN 'UTF8' ELSE coalesce(e, '{DEFAULT}') END AS web FROM part LEFT JOIN (VALUES {_CHARSET_VALUES}) c(k, e) ON 1024 + p_partkey = k")
def encoding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Charset of a locale id; the ids are made from a key column."""
    dim = spark.createDataFrame(sorted(CHARSETS.items()), "k long, e string")
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") + 1024).alias("k"))
    enc = F.coalesce("e", F.lit(DEFAULT))
    return p.join(F.broadcast(dim), "k", "left").select("p_partkey", enc.alias("encoding"), scalars.fix_encoding(enc).alias("web"))


@_add("highlight", """SELECT doc_id, md5(regexp_replace(text, '(?i)(\\Qanea eriner\\E|\\Qthing\\E)', '<span class="searchword">\\1</span>', 'g')) AS marked FROM documents WHERE text IS NOT NULL""")
def highlight(spark: SparkSession, sf: str) -> DataFrame:
    d = virtual.documents(spark, sf).filter("text IS NOT NULL")
    return d.select("doc_id", F.md5(scalars.highlight(F.col("text"), '"anea eriner" thing')).alias("marked"))


_PAGE = f"""p AS (SELECT doc_id // {archives.BIN} AS book, doc_id, '/' || doc_id || path AS path, coalesce(title, '/' || doc_id || path) AS topic, title, coalesce(text, '') AS text, string_split(path, '/')[2] AS host FROM ({_DOCS['pages']}))"""
_WORDS = "w AS (SELECT book, path, topic, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT *, regexp_extract_all(lower(topic), '[a-z0-9]+') AS x FROM p))"
_SQL_OF_ARCHIVES = {
    "archive_units": (archives.entries, f"WITH {_PAGE} SELECT book, path, strlen(text)::BIGINT AS length, CASE WHEN path LIKE '%/' THEN 17 ELSE 9 END::INT AS flags FROM p"),
    "archive_objects": (archives.objects, f"WITH {_PAGE} SELECT book, path, md5(text) AS digest, md5(text) AS text_digest FROM p"),
    "archive_info": (archives.info, f"WITH {_PAGE} SELECT book, 'Book ' || book AS title, arg_min(path, host || '/' || path) AS home_file, 'UTF-8' AS encoding, 'quirefold' AS generator, true AS has_index FROM p GROUP BY 1"),
    "archive_topics": (archives.topics, f"WITH {_PAGE} SELECT book, path, topic, host AS chapter, row_number() OVER (PARTITION BY book, host ORDER BY path) - 1 AS place FROM p"),
    "archive_postings": (archives.postings, f"WITH {_PAGE}, {_WORDS} SELECT book, word, 1 AS context, path AS url, topic, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM w GROUP BY ALL"),
}
for _name, (_run, _sql) in _SQL_OF_ARCHIVES.items():
    _add(_name, _sql)(_run)


@_add("archive_search", f"""WITH {_PAGE}, {_WORDS}, m AS (SELECT book, path, topic, sum((starts_with(word, 'th'))::INT)::BIGINT AS a, sum((starts_with(word, 'a'))::INT)::BIGINT AS b FROM w GROUP BY ALL)
    SELECT book, path AS url, topic, a + b AS score FROM m WHERE a > 0 AND b > 0""")
def archive_search(spark: SparkSession, sf: str) -> DataFrame:
    """All archives' own indexes at once: words by their beginnings."""
    return archives.search(spark, sf, "th a")
