"""URL filters by association rules.

A URL is a set of tokens (scheme, host labels and suffixes, shapes of path segments, extension, query keys,
fragment). A list of fixed rules comes first. Spark's FP-growth mines the token sets of labelled pages together
with their label. A rule from tokens to a label is pruned by support (a number of pages with both, whatever the size
of the table) and by confidence against the label's share of all labelled pages: its certainty, (confidence - share)
/ (1 - share), says how much of the way from the share to 1 it goes, so a rare label needs less confidence than a
common one, and a rule that only repeats the share is none. A rule is found through its rarest token (inverted index)
and holds if all its tokens are there; the rule of highest certainty decides, then the one with more tokens, then the
higher support. Without any rule a URL is allowed.

Tokens that stand on exactly the same labelled pages are mined as one (a rule on them needs all), which loses no
rule. All tokens of a URL are mined. Their itemsets can double with each token that many pages have and others lack,
so labelled URLs with dozens of such tokens take long; a caller of mine_rules who can do with fewer rules may give a
width, and then of a URL's tokens only so many are mined, those whose own labels differ most from the share. The
query gives none. All pages are counted, and all tokens of a URL are held against the rules.

The query's labels are the verdicts of the fixed rules, on the pages that these decide: the mined rules carry them
over to the other URLs. The table `labels` is one of documents, by doc_id, and isn't read.

Matching runs once per distinct token set of the URLs without a fixed rule, so a host with a third of all pages
costs one set per shape of its URLs. The rule table is joined by Spark's choice of join, by measured size.

Nulls: a null URL, or one without "://", has an empty host and path and no tokens; it matches no rule. Null ids
are kept. Null labels are none. Repeated rows: judged alike; in mining each labelled row counts. Empty tables: no
rows, or no rules. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.common import materialize, table

#: (host, path, verdict); the longest that fits wins
FIXED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A rule needs so many labelled pages with its label, and this certainty. WIDTH: mined tokens of a URL for callers who want a bound.
MIN_PAGES, MIN_CERTAINTY, WIDTH = 20, 0.3, 14
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + F.lit(1)), r"^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), none), F.coalesce(path, none)


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens; digits in path segments are shapes, as their values don't repeat."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    shape = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"[0-9]+", "0"))
    segments = F.transform(shape, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.regexp_extract(s, r"^[^=]*", 0)))
    sub = F.when(n > 2, F.array(F.concat(F.lit("sub:"), F.element_at(labels, 1)))).otherwise(F.array().cast("array<string>"))
    other = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([^:]*)://", 1))),
        F.concat(F.lit("depth:"), F.size(shape).cast("string")),
        F.when(path.endswith("/"), "end:/").when(path.rlike(r"\.[A-Za-z0-9]+$"), F.concat(F.lit("end:"), F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))).otherwise("end:"),
        F.when(F.locate("#", url) > 0, "fragment:yes").otherwise("fragment:no"),
    )
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(suffixes, segments, keys, sub, other)))).otherwise(F.array().cast("array<string>"))


def _narrowed(sets: DataFrame, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((tokens, verdict) with the tokens to be mined, one for all that stand on the same pages, and at most `width` of a set if given; (stands, alike): a mined token and all that it stands for)."""
    rows = materialize(sets.withColumn("row", F.monotonically_increasing_id()), "labelled-sets")
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    # tokens of equal page sets have equal sums of hashed row numbers
    page_set = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("set")
    by_token = each.groupBy("token").agg(F.count("*").alias("n"), page_set)
    if width is None:
        kinds = materialize(by_token.groupBy("n", "set").agg(F.min("token").alias("stands"), F.collect_set("token").alias("alike")), "token-kinds")
        kept = each.join(kinds.select(F.col("stands").alias("token")), "token").groupBy("row", "verdict").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        return kept.select("verdict", "tokens"), kinds.select("stands", "alike")
    share = rows.groupBy("verdict").agg((F.count("*") / F.sum(F.count("*")).over(Window.partitionBy())).alias("share"))  # a row per label
    by_label = each.groupBy("token", "verdict").agg(F.count("*").alias("k")).join(F.broadcast(share), "verdict")
    # how far the labels of a token's pages are from the share of all, summed over labels
    total = by_label.groupBy("token").agg(F.sum("k").alias("all"))
    tells = by_label.join(total, "token").groupBy("token").agg(F.sum(F.abs(F.col("k") - F.col("share") * F.col("all")) / F.sqrt(F.col("all"))).alias("tells"))
    kinds = by_token.join(tells, "token").groupBy("n", "set").agg(F.min("token").alias("stands"), F.collect_set("token").alias("alike"), F.min_by("tells", "token").alias("tells"))
    kinds = materialize(kinds, "token-kinds")
    kept = each.join(kinds.select(F.col("stands").alias("token"), "tells"), "token").groupBy("row", "verdict").agg(F.array_sort(F.collect_list(F.struct((-F.col("tells")).alias("t"), "token"))).alias("t"))
    return kept.select("verdict", F.slice(F.col("t.token"), 1, width).alias("tokens")), kinds.select("stands", "alike")


def mine_rules(sets: DataFrame, min_pages: int = MIN_PAGES, min_certainty: float = MIN_CERTAINTY, width: int | None = None) -> DataFrame:
    """(tokens, verdict, confidence, certainty, support, rarest) from (tokens, verdict) rows, one per labelled page; none from fewer than min_pages."""
    from pyspark.ml.fpm import FPGrowth

    spark = sets.sparkSession
    none = "tokens array<string>, verdict string, confidence double, certainty double, support double, rarest string"
    narrow, kinds = _narrowed(sets.filter((F.size("tokens") > 0) & F.col("verdict").isNotNull()), width)
    items = materialize(narrow.select(F.concat("tokens", F.array(F.concat(F.lit("label:"), "verdict"))).alias("items")), "transactions")
    n = items.count()
    if n < min_pages:
        return spark.createDataFrame([], none)
    model = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / n).fit(items)
    is_label = lambda t: t.startswith("label:")
    found = model.freqItemsets.select(F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("mined"), F.get(F.filter("items", is_label), 0).alias("label"), "freq")
    found = materialize(found, "itemsets")
    of_label = found.filter("label IS NOT NULL")
    share = of_label.filter(F.size("mined") == 0).select("label", (F.col("freq") / n).alias("share"))
    of_tokens = found.filter("label IS NULL").select("mined", F.col("freq").alias("n_tokens"))
    rules = of_label.filter(F.size("mined") > 0).join(of_tokens, "mined").join(F.broadcast(share), "label").withColumn("confidence", F.col("freq") / F.col("n_tokens"))
    rules = rules.withColumn("certainty", F.when(F.col("share") == 1, F.col("confidence")).otherwise((F.col("confidence") - F.col("share")) / (1 - F.col("share"))))
    rules = rules.filter(F.col("certainty") >= min_certainty).select("mined", F.substring("label", 7, 1 << 20).alias("verdict"), "confidence", "certainty", (F.col("freq") / n).alias("support"))
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("mined", "verdict")), "mined-rules")
    single = of_tokens.filter(F.size("mined") == 1).select(F.get("mined", 0).alias("stands"), "n_tokens").join(kinds, "stands")
    parts = rules.select("rule_id", F.explode("mined").alias("stands")).join(single, "stands")
    full = parts.groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("alike"))).alias("tokens"), F.min_by("stands", F.struct("n_tokens", "stands")).alias("rarest"))
    return materialize(rules.join(full, "rule_id").select("tokens", "verdict", "confidence", "certainty", "support", "rarest"), "rules")


def judge_urls(pages: DataFrame, labelled: DataFrame | None, id_col: str = "page_id", url_col: str = "url", fixed=FIXED, min_pages: int = MIN_PAGES, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """id, host, path, rule, verdict, mined_confidence. labelled: (id, verdict) rows, joined to pages on the id; without any, nothing is mined."""
    base = _parsed(pages, id_col, url_col, fixed)
    if labelled is None:
        return _judge(base, None, id_col)
    return _judge(base, mine_rules(base.join(labelled.select(F.col("id"), "verdict"), "id").select("tokens", "verdict"), min_pages, min_certainty), id_col)


def extend_fixed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", fixed=FIXED, min_pages: int = MIN_PAGES, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """As judge_urls, with the verdicts of the fixed rules as labels of the pages that they decide."""
    base = _parsed(pages, id_col, url_col, fixed)
    return _judge(base, mine_rules(base.select("tokens", F.col("fixed").alias("verdict")), min_pages, min_certainty), id_col)


def _parsed(pages: DataFrame, id_col: str, url_col: str, fixed) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    base = base.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("key", F.xxhash64("tokens"))
    return base.withColumn("rule", rule).withColumn("fixed", verdict)


def _judge(base: DataFrame, mined: DataFrame | None, id_col: str) -> DataFrame:
    if mined is None:
        mined = base.limit(0).select("tokens", F.lit("").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("certainty"), F.lit(0.0).alias("support"), F.lit("").alias("rarest"))
    mined = mined.select(F.col("tokens").alias("needs"), F.col("verdict").alias("said"), "confidence", "certainty", "support", "rarest")
    sets = base.filter("fixed IS NULL").select("key", "tokens").dropDuplicates(["key"])
    hit = sets.withColumn("token", F.explode("tokens")).join(mined, F.col("token") == F.col("rarest")).filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = hit.groupBy("key").agg(F.max(F.struct("certainty", F.size("needs").alias("n"), "support", F.array_join("needs", " ").alias("text"), "said", "confidence")).alias("b")).select("key", "b.confidence", "b.said")
    judged = base.drop("tokens", "url").join(best, "key", "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", "said", F.lit("allow")).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("confidence")).alias("mined_confidence"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extend_fixed(table(spark, sf_dir, "pages"))


QUERIES = {"op8_urls": op8_urls}
ORACLES: dict[str, str] = {}
