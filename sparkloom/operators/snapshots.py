"""Incremental change detection and versions of a set of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, changed, removed or unchanged, by one full outer join."""
    a = old.select(F.col(key), F.col(digest).alias("__old"))
    b = new.select(F.col(key), F.col(digest).alias("__new"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def source_version(files: DataFrame, key: str, digest: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """One SHA-1 over all (key, digest) in key order.

    Only the short digests meet in one place: 40 bytes a file.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(digest).alias("d"))))
    folded = F.array_join(F.transform(pairs, lambda p: F.concat(p[key].cast("string"), F.lit("\0"), p["d"])), "\n")
    return files.groupBy(*groups).agg(F.sha1(folded).alias("version"), F.count("*").alias("files"))


def folder_digests(files: DataFrame, rel: str, digest: str) -> DataFrame:
    """(folder, digest) of every folder above the files, the root's under the empty name.

    A folder's digest is the SHA-1 of its children's names and digests in order of
    names, files before folders; so a changed file changes the digests on its path and
    no others. Folders are made level by level, the deepest first, each from its own
    children alone.
    """
    depth = F.size(F.split("path", "/"))
    parent, name = F.regexp_replace("path", "/?[^/]*$", ""), F.regexp_extract("path", "[^/]*$", 0)
    level = files.select(F.col(rel).alias("path"), F.lit(False).alias("folder"), F.col(digest).alias("digest")).withColumn("depth", depth)
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out = None
    above = None  # folders of the level below
    for at in range(deepest, 0, -1):
        children = level.where(F.col("depth") == at).drop("depth")
        if above is not None:
            children = children.unionByName(above)
        line = F.sort_array(F.collect_list(F.struct("folder", "name", "digest")))
        folded = F.array_join(F.transform(line, lambda c: F.concat(F.when(c["folder"], "d").otherwise("f"), F.lit("\0"), c["name"], F.lit("\0"), c["digest"])), "\n")
        made = children.select(parent.alias("parent"), "folder", name.alias("name"), "digest").groupBy("parent").agg(F.sha1(folded).alias("digest"))
        above = made.select(F.col("parent").alias("path"), F.lit(True).alias("folder"), "digest")
        own = made.select(F.col("parent").alias("folder"), "digest")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else files.sparkSession.createDataFrame([], "folder string, digest string")


def first_of_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    from pyspark.sql import Window

    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
