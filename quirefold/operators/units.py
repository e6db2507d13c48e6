"""Directory entries (units): flags, filters, enumeration, lookup, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, META, SPECIAL, FILES, DIRS = 1, 2, 4, 8, 16
USER, ALL = NORMAL | FILES | DIRS, 31


def unit_flags(path: Column) -> Column:
    kind = F.when(~path.startswith("/"), META).when(path.startswith("/#") | path.startswith("/$"), SPECIAL).otherwise(NORMAL)
    shape = F.when(path.endswith("/"), DIRS).otherwise(FILES)
    return F.when(path.endswith(".hhc") | path.endswith(".hhk"), META).otherwise(kind.bitwiseOR(shape)).cast("int")


def matches(flags: Column, what: int) -> Column:
    """The type bits must meet, and so must the file and directory bits where any are asked for."""
    kind, shape = what & 7, what & 0xF8
    ok = flags.bitwiseAND(kind) != 0
    return ok & (flags.bitwiseAND(shape) != 0) if shape else ok


def type_label(flags: Column) -> Column:
    kind = F.when(flags.bitwiseAND(NORMAL) != 0, "normal").when(flags.bitwiseAND(SPECIAL) != 0, "special").when(flags.bitwiseAND(META) != 0, "meta").otherwise("")
    shape = F.when(flags.bitwiseAND(DIRS) != 0, " dir").when(flags.bitwiseAND(FILES) != 0, " file").otherwise("")
    return F.concat(kind, shape)


def directory_map(units: DataFrame) -> DataFrame:
    """One unit per case-insensitive path of an archive: the values of the last entry at the place of the first."""
    keys = [c for c in ("archive_id",) if c in units.columns]
    rest = [c for c in units.columns if c not in (*keys, "ord", "path_key")]
    by = units.withColumn("path_key", F.lower("path")).groupBy(*keys, "path_key").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("_u"))
    return by.select(*keys, "ord", "path_key", *(F.col(f"_u.{c}").alias(c) for c in rest))


def contents_alias(units: DataFrame) -> DataFrame:
    """(archive_id, path): the unit that stands for /@contents, the last with the extension .hhc."""
    return units.filter(F.lower("path").endswith(".hhc")).groupBy("archive_id").agg(F.max_by("path", "ord").alias("path"))


def enumerate_units(units: DataFrame, what: int = ALL) -> DataFrame:
    """In directory order."""
    return units.filter(matches(F.col("flags"), what)).orderBy("ord")


def enumerate_dir(units: DataFrame, prefix: str, what: int = USER) -> DataFrame:
    """(ord, path, length, flags) of the direct children of a directory, in order; deeper entries stand for a directory of length 0."""
    prefix = prefix if prefix.endswith("/") else prefix + "/"
    rest = F.substring("path", len(prefix) + 1, 1 << 20)
    inside = units.filter(F.col("path").startswith(prefix) & (F.col("path") != prefix)).withColumn("_child", F.regexp_extract(rest, r"^/*[^/]*/?", 0))
    own = F.col("_child") == rest
    child = inside.groupBy("_child").agg(
        F.min("ord").alias("ord"),
        F.max_by(F.when(own, F.struct("length", "flags")), F.when(own, F.col("ord"))).alias("_u"),
    )
    path = F.concat(F.lit(prefix), "_child")
    out = child.select("ord", path.alias("path"), F.coalesce("_u.length", F.lit(0)).cast("long").alias("length"), F.coalesce("_u.flags", F.lit(NORMAL | DIRS)).cast("int").alias("flags"))
    return out.filter(matches(F.col("flags"), what)).orderBy("ord")


def directory_listing(units: DataFrame, prefix: str) -> DataFrame:
    """(ord, href, name, size, is_dir) of a directory page; the row of the parent comes first."""
    from quirefold.functions.scalars import fix_link

    prefix = prefix if prefix.endswith("/") else prefix + "/"
    rows = enumerate_dir(units, prefix).select(
        F.col("ord").cast("long").alias("ord"), fix_link(F.col("path")).alias("href"), F.substring("path", len(prefix) + 1, 1 << 20).alias("name"),
        F.when(F.col("length") > 0, F.col("length")).alias("size"), (F.col("length") <= 0).alias("is_dir"),
    )
    parent = prefix[:-1].rpartition("/")[0] + "/"
    if prefix == "/":
        return rows
    up = units.sparkSession.range(1).select(F.lit(-1).cast("long").alias("ord"), fix_link(F.lit(parent)).alias("href"), F.lit("..").alias("name"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir"))
    return up.unionByName(rows).orderBy("ord")


def resolve(units: DataFrame, path: str) -> DataFrame:
    """The unit of a path, ignoring case."""
    return units.filter(F.col("path_key") == path.lower())


def byte_range(content: Column, address: int, length: int) -> Column:
    """Bytes from an address on, cut at the end; null if the address isn't inside."""
    n = F.length(content)
    if address < 0:
        return F.lit(None).cast("binary")
    return F.when(F.lit(address) < n, F.substring(content, address + 1, length))
