"""Topic trees and file trees as adjacency tables; printing and JSON."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.common import with_row_numbers

MAX_FULL, DEEP, SHALLOW, RELEASE = 10_000, 100, 2, 60_000


def files_tree(units: DataFrame, home: str = "/", name: str = "files-tree") -> DataFrame:
    """(id, parent_path, level, path, title, ord): directories, also those that only show in paths, and files below the root.

    Only directories have ids, in the order of the tree; the root has 0. The first two children of the root are
    the main page and the root directory.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - F.when(F.col("path").endswith("/"), 2).otherwise(1)
    own = units.filter(F.col("path").startswith("/") & (F.col("path") != "/")).select("ord", "path", depth.alias("level"))
    above = own.select("ord", F.explode(F.when(F.col("level") > 1, F.sequence(F.lit(1), F.col("level") - 1)).otherwise(F.array().cast("array<int>"))).alias("level"), "path")
    above = above.select("ord", F.concat(F.array_join(F.slice(F.split("path", "/"), 1, F.col("level") + 1), "/"), F.lit("/")).alias("path"), "level")
    nodes = own.unionByName(above).groupBy("path", "level").agg(F.min("ord").alias("ord"))
    dirs = with_row_numbers(nodes.filter(F.col("path").endswith("/")), name, F.col("ord"), F.col("level"), column="id").withColumn("id", (F.col("id") + 1).cast("int"))
    nodes = nodes.filter(~F.col("path").endswith("/")).withColumn("id", F.lit(None).cast("int")).unionByName(dirs)
    parent = F.regexp_extract("path", r"^(.*/)[^/]+/?$", 1)
    nodes = nodes.select("id", parent.alias("parent_path"), "level", "path", F.regexp_extract("path", r"([^/]+/?)$", 1).alias("title"), F.col("ord").cast("long").alias("ord"))
    fixed = [(0, None, 0, "/", "", -3), (None, "/", 1, "/nonchmweb/" if home == "/" else home, "Main Page", -2), (None, "/", 1, "/nonchmweb/", "Root Directory", -1)]
    return units.sparkSession.createDataFrame(fixed, nodes.schema).unionByName(nodes)


def path_subtree(tree: DataFrame, id_: int) -> DataFrame:
    """The nodes of a file tree under the directory of that id, itself included."""
    root = tree.filter(F.col("id") == id_).select(F.col("path").alias("_root"))
    return tree.join(F.broadcast(root.limit(1)), tree["path"].startswith(F.col("_root"))).drop("_root")


def topic_subtree(topics: DataFrame, id_: int) -> DataFrame:
    """The nodes of a topics tree under a node, itself included; nodes are numbered from the top, so its end is the next node that isn't deeper."""
    root = topics.filter(F.col("id") == id_).select("archive_id", F.col("level").alias("_level"))
    after = topics.join(root, "archive_id").filter((F.col("id") > id_) & (F.col("level") <= F.col("_level")))
    end = after.groupBy("archive_id").agg(F.min("id").alias("_end"))
    out = topics.join(root.select("archive_id"), "archive_id").join(end, "archive_id", "left")
    return out.filter((F.col("id") >= id_) & (F.col("_end").isNull() | (F.col("id") < F.col("_end")))).drop("_end")


def depth_limit(count: int) -> int:
    return SHALLOW if count > MAX_FULL else DEEP


def limit_depth(tree: DataFrame, most: int) -> DataFrame:
    """Nodes down to a level; load_by_id marks those there that have more below, by path."""
    below = tree.filter(F.col("level") == most + 1).select(F.col("parent_path").alias("path")).distinct().withColumn("load_by_id", F.lit(True))
    return tree.filter(F.col("level") <= most).join(below, "path", "left").withColumn("load_by_id", F.coalesce("load_by_id", F.lit(False)) & F.col("id").isNotNull())


def titles(topics: DataFrame) -> DataFrame:
    """(archive_id, path_key, title), the last of a path."""
    return topics.filter("path <> ''").groupBy("archive_id", F.lower("path").alias("path_key")).agg(F.max_by("title", "id").alias("title"))


def indented(level: Column, title: Column, path: Column) -> Column:
    return F.concat(F.repeat(F.lit("    "), level), title, F.lit("\t"), path)


def tree_json(rows: list[tuple], key: str = "id", most: int = DEEP) -> str:
    """JSON of a tree from (id, parent, level, path, title) rows in order, parents as ids or paths: nodes are [path, title] with children, or "load-by-id" and the id where it is cut; of the root only its children show."""
    from_root = rows[0]
    children: dict = defaultdict(list)
    for r in rows[1:]:
        children[r[1]].append(r)
    own = (lambda r: r[0]) if key == "id" else (lambda r: r[3])

    def node(r: tuple, level: int):
        kids = children.get(own(r), []) if own(r) is not None else []
        title = r[4] or "untitled"
        if not kids:
            if level == 0 and not r[3] and title.lower() == "untitled":
                return []
            path = "/nonchmweb/" if r[3] == "/" else "/nonchmweb/" + r[3][8:] if r[3].startswith("/chmweb/") else r[3]
            return [path, title] if r[3] or title.lower() != "untitled" else []
        if level == 0:
            return [node(k, 1) for k in kids]
        if level == most:
            return [r[3], title, "load-by-id", r[0]] if r[0] else [r[3], title]
        return [r[3], title, [node(k, level + 1) for k in kids]]

    return json.dumps(node(from_root, 0), ensure_ascii=False)
